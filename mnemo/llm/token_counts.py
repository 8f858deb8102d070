"""Operator 2, token counts from a digest cache.

Every text is reduced to the SHA-256 of its normalised content (null as empty); with the SHA-256 of the tokenizer file
that is the key of a stored count. Keys the cache lacks are counted once per distinct text and appended. Shuffles move
digests, but for one: the rows that stand for the missing digests fetch their texts. Copies fold in the partial
aggregation, and a digest of a third of all rows joins by a sort-merge join, which adaptive execution splits.

Defined cases: a null text is empty and has 0 tokens; null ids are kept; repeated rows each get a row; a very long text is counted whole, alone in
its chunk; of rows that tie for a digest the one with the least id stands for it; an empty table gives an empty result and leaves the cache as it
was; further columns are left aside.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Callable
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemo.llm.common import Scratch, chunks, text_of, tidy

SCHEMA = "digest binary, version string, n_tokens bigint"


@lru_cache(maxsize=4)
def counter(name: str, blob: bytes) -> Callable[[list[str]], list[int]]:
    """Counts tokens as the library for this kind of file does."""
    if name.endswith(".model"):
        import sentencepiece

        tool = sentencepiece.SentencePieceProcessor(model_proto=blob)
        return lambda texts: [len(x) for x in tool.encode(texts, num_threads=1)]
    if name.endswith(".json"):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tool = Tokenizer.from_str(blob.decode())
        tool.no_truncation()
        tool.no_padding()
        return lambda texts: [len(x.ids) for x in tool.encode_batch(texts, add_special_tokens=False)]
    if name.endswith(".tiktoken"):
        import public_tokenizers
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, blob.splitlines())}
        tool = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        return lambda texts: [len(tool.encode_ordinary(x)) for x in texts]
    raise ValueError(f"no library for {name}")


def token_counts(docs: DataFrame, tokenizer: str | None = None, cache: str | None = None, limit: int = 4096) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit. `cache`: path of a table of SCHEMA, read if it is there and appended to;
    without one, a new table in the shared folder."""
    spark = docs.sparkSession
    tidy(spark)
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("piece_bpe_32k.model")
    with open(tokenizer, "rb") as f:
        blob = f.read()
    version = hashlib.sha256(blob).hexdigest()
    cache = cache or Scratch(spark, "tokens").path("counts")
    rows = docs.select("doc_id", text_of().alias("text")).withColumn("digest", F.unhex(F.sha2("text", 256)))

    jvm = spark._jvm.org.apache.hadoop.fs.Path(cache)
    there = jvm.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jvm)
    wanted = rows.groupBy("digest").agg(F.min("doc_id").alias("_at"))
    if there:
        known = spark.read.schema(SCHEMA).parquet(cache).filter(F.col("version") == version)
        wanted = wanted.join(known, "digest", "left_anti")
    wanted = wanted.withColumnRenamed("digest", "_digest").hint("shuffle_hash")
    missing = rows.join(wanted, F.col("doc_id").eqNullSafe(F.col("_at")) & (F.col("digest") == F.col("_digest"))).select("digest", "text")

    def count(batches):
        tool = counter(tokenizer, blob)
        for part in chunks(batches):
            n = pa.array(tool(part.column("text").to_pylist()), pa.int64())
            yield pa.RecordBatch.from_arrays([part.column("digest"), n], ["digest", "n_tokens"])

    # rows that repeat an id and its text both stand for the digest; one of their equal counts is stored
    counted = missing.mapInArrow(count, "digest binary, n_tokens bigint").groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))
    counted.select("digest", F.lit(version).alias("version"), "n_tokens").write.mode("append").parquet(cache)

    # runs that share a cache may both append a digest; the join shuffles by it anyway
    stored = spark.read.schema(SCHEMA).parquet(cache).filter(F.col("version") == version).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))
    return (
        rows.select("doc_id", "digest", F.octet_length("text").cast("long").alias("n_bytes"))
        .join(stored, "digest")
        .select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
    )
