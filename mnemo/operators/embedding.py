"""Embedding upkeep: which memories need a vector, running the provider where the rows are, storing what it returns."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Embed = Callable[[list[str]], list[list[float]]]


def embed_batch(backlog: DataFrame, embed: Embed, batch: int = 64) -> DataFrame:
    """Adds vector, hash and outcome (stored or retry: a failing provider fails its batch only). Runs in the tasks that hold the rows."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at in range(0, len(pdf), batch):
                part = pdf.iloc[at : at + batch]
                try:
                    vectors, outcome = embed(part.content.tolist()), "stored"
                except Exception:  # told by the outcome
                    vectors, outcome = [None] * len(part), "retry"
                yield part.assign(vector=vectors, outcome=outcome)

    out = backlog.mapInPandas(work, backlog.schema.simpleString()[7:-1] + ",vector:array<float>,outcome:string")
    return out.withColumn("hash", F.sha2("content", 256))


def store(memories: DataFrame, embedded: DataFrame, model: str) -> DataFrame:
    """Memories with the vectors written in, matched by space and id, and only while the text is the one that was embedded."""
    done = embedded.filter("outcome = 'stored'").select("memory_space_id", "memory_id", F.col("vector").alias("_v"), F.col("hash").alias("_h"))
    joined = memories.join(done, ["memory_space_id", "memory_id"], "left")
    new = F.col("_v").isNotNull() & F.col("_h").eqNullSafe(F.sha2("content", 256))
    extra = {"embedding_model": F.when(new, F.lit(model)), "dimensions": F.when(new, F.size("_v"))}
    old = {c: F.coalesce(x, F.col(c)) if c in memories.columns else x for c, x in extra.items()}
    return joined.withColumns({"embedding": F.when(new, F.col("_v")).otherwise(F.col("embedding")), "content_hash": F.when(new, F.col("_h")).otherwise(F.col("content_hash"))} | old).drop("_v", "_h")


def outcome_counts(embedded: DataFrame) -> DataFrame:
    return embedded.groupBy("outcome").agg(F.count("*").alias("n"))


def delivery(events: DataFrame) -> DataFrame:
    """What a subscriber does with each delivered event. events: decoded, store_error (null, transient, fatal), refused, may_distill, event_space, row_space, provider_failed, settled."""
    ack = (
        F.when(~F.col("decoded"), "dead-letter")
        .when(F.col("store_error") == "transient", "retry")
        .when(F.col("store_error").isNotNull(), "halt")
        .when(F.col("refused") | ~F.col("may_distill"), "dead-letter")
        .when(F.col("row_space").isNotNull() & (F.col("event_space") != F.col("row_space")), "dead-letter")
        .when(F.col("settled"), "ok")
        .when(F.col("provider_failed"), "retry")
        .otherwise("ok")
    )
    return events.withColumn("ack", ack)
