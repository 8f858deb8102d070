"""Model tables derived from the supplied parquet tables, column by column, so nothing is read that a query doesn't need."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

def _start() -> Column:
    return F.to_timestamp(F.lit("2024-01-01 00:00:00"))


def _later(hours: Column, minutes: Column | None = None) -> Column:
    return F.timestamp_seconds(F.unix_timestamp(_start()) + hours.cast("long") * 3600 + (minutes.cast("long") * 60 if minutes is not None else 0))


def padded(prefix: str, number: Column) -> Column:
    return F.concat(F.lit(prefix), F.lpad(number.cast("string"), 8, "0"))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def memories(spark: SparkSession, sf_dir: str, by_tens: bool = False, vectors: bool = False) -> DataFrame:
    """documents with their labels. by_tens: spaces by tens of ids, so supersession stays inside a space. vectors: with embeddings, which only some
    reads need."""
    d, n = read(spark, sf_dir, "documents"), F.col("doc_id")
    labels = read(spark, sf_dir, "labels").select(F.col("doc_id").alias("_l"), "quality")
    other = (F.floor(n / 10) % 2 == 1) if by_tens else (n % 5 == 0)
    scoped = n % 4 != 0
    d = d.join(labels, n == F.col("_l"), "left")
    if vectors:
        d = d.join(read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("_v"), "embedding"), n == F.col("_v"), "left")
    return (
        d.select(
            F.when(other, "space_other").otherwise("space_test").alias("memory_space_id"),
            padded("m_", n).alias("memory_id"),
            F.concat(F.lit("agent_"), (n % 7).cast("string")).alias("agent_id"),
            F.when(n % 3 == 0, padded("s_", n % 10)).alias("session_id"),
            F.col("lang").alias("namespace"),
            F.when(scoped, "source").alias("scope_kind"),
            F.when(scoped, F.col("source")).alias("scope_ref"),
            F.element_at(F.array(*[F.lit(x) for x in ("fact", "pattern", "preference", "constraint", "instruction")]), (n % 5 + 1).cast("int")).alias("memory_type"),
            F.col("text").alias("content"),
            (n * 37 % 121).cast("int").alias("priority"),
            F.when(F.col("quality") == 1, "high").when(F.col("quality") == 0, "low").otherwise("medium").alias("confidence"),
            F.array("lang", "source").alias("tags"),
            F.when(n % 10 == 7, "archived").when(n % 10 == 8, "superseded").when(n % 10 == 9, "merged").otherwise("active").alias("status"),
            F.when((n % 10).isin(8, 9), padded("m_", n - n % 10)).alias("superseded_by"),
            F.when(n % 10 == 0, padded("m_", n + 8)).alias("supersedes"),
            *["embedding"] * vectors,
            F.when(n % 2 == 0, F.sha2("text", 256)).when(n % 6 == 1, "stale").alias("content_hash"),
            _later(n).alias("created_at"),
            _later(n + 1).alias("updated_at"),
        )
    )


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, n = read(spark, sf_dir, "conversations"), F.col("conv_id")
    sid = padded("s_", n)
    return c.select(
        F.when(F.floor(n / 8) % 2 == 1, "space_other").otherwise("space_test").alias("memory_space_id"),
        F.concat(sid, F.lit("-"), F.col("turn").cast("string")).alias("turn_id"),
        sid.alias("session_id"),
        F.col("turn").cast("int").alias("turn_index"),
        "role",
        F.col("text").alias("content"),
        F.lit(None).cast("string").alias("tool_summary"),
        F.octet_length("text").cast("int").alias("prompt_tokens"),
        F.lit(None).cast("int").alias("output_tokens"),
        _later(n, F.col("turn")).alias("recorded_at"),
    )


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("conv_id")
    status = F.element_at(F.array(*[F.lit(x) for x in ("running", "awaiting", "completed", "failed", "interactive")]), (n % 5 + 1).cast("int"))
    return read(spark, sf_dir, "conversations").select("conv_id").distinct().select(
        F.when(F.floor(n / 8) % 2 == 1, "space_other").otherwise("space_test").alias("memory_space_id"),
        padded("s_", n).alias("session_id"),
        F.concat(F.lit("agent_"), (n % 7).cast("string")).alias("agent_id"),
        F.concat(F.lit("focus_"), (n % 4).cast("string")).alias("focus"),
        F.lit("chat").alias("namespace"),
        F.when(n % 3 != 0, "topic").alias("scope_kind"),
        F.when(n % 3 != 0, F.concat(F.lit("t"), (n % 3).cast("string"))).alias("scope_ref"),
        F.when(n % 8 != 0, padded("s_", n - 1)).alias("previous_session_id"),
        F.when(n % 8 == 7, padded("s_", n - n % 8)).alias("parent_session_id"),
        F.when(n % 8 == 7, 1).otherwise(0).alias("delegation_depth"),
        status.alias("status"),
        F.when(status == "awaiting", F.concat(F.lit("key_"), (n % 3).cast("string"))).alias("awaiting_correlation_key"),
        _later(n).alias("started_at"),
        _later(n).alias("created_at"),
    )


def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One stream per user, in order of time and id: space, stream_id, version, kind, k (of the payload), event_id, at."""
    e = read(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "props")
    version = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    k = F.get_json_object("props", "$.k").cast("int")
    e = e.select("user_id", "event_id", F.col("ts").cast("timestamp").alias("at"), "event_type", k.alias("k"), version.alias("version"))
    kind = F.when(F.col("version") == 1, "recorded").when(F.col("event_type") == "signup", "superseded").when(F.col("event_type") == "error", "archived").when(F.col("event_type") == "click", "tags").when(F.col("event_type") == "view", "confidence").otherwise("merged")
    return e.select(
        F.when((F.col("version") > 1) & (F.col("k") % 11 == 0), "space_other").otherwise("space_test").alias("memory_space_id"),
        padded("u_", F.col("user_id")).alias("stream_id"), "version", kind.alias("kind"), "k", "event_id", "at",
    )
