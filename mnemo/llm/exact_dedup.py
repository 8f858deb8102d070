"""Operator 6, exact dedup: group by a 128-bit content hash, keep the smallest id, compare bytes inside groups.

DataFrame functions only. One shuffle moves each distinct text of a partition once (partial aggregation folds copies
where they are read, so a group with a third of all rows sends one row per task); it brings the least and the greatest
text of each hash together. They are equal unless two texts collide. The second shuffle joins 16-byte hashes with
their groups, and adaptive execution splits a hot hash. Groups that collide are grouped anew by their whole texts.

Defined cases: a null text is empty and equals other empty texts; a null id sorts after all ids, and a group of null ids
alone has a null keep_id and all its rows are marked as kept; rows that repeat id and text count as one row met twice and share the verdict
(exact_dedup keeps one of either); long texts are whole; an empty table gives an empty result; further columns are left aside.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemo.llm.common import Scratch, text_of, tidy

SPACE = r"[\x20\x09-\x0D]+"


def normalised(column: str = "text") -> Column:
    return F.regexp_replace(text_of(column), SPACE, " ")


def exact_groups(docs: DataFrame, digest: Column | None = None) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row. `digest`: another hash of `body`, for tests."""
    spark = docs.sparkSession
    tidy(spark)
    digest = F.unhex(F.md5("body")) if digest is None else digest
    rows = docs.select("doc_id", normalised().alias("body")).withColumn("hash", digest)
    groups = Scratch(spark, "exact").put(
        "groups",
        rows.groupBy("hash").agg(
            F.min("doc_id").alias("keep_id"),
            F.count(F.lit(1)).alias("group_size"),
            (F.min("body") != F.max("body")).alias("collides"),
        ),
    )
    slim = rows.select("doc_id", "hash", F.sha2("body", 256).alias("text_sha256"))
    plain = slim.join(groups.filter(~F.col("collides")), "hash")
    if groups.filter("collides").isEmpty():
        found = plain
    else:
        clash = rows.join(groups.filter("collides").select("hash"), "hash", "left_semi")
        apart = clash.groupBy("hash", "body").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        again = clash.join(apart, ["hash", "body"]).withColumn("text_sha256", F.sha2("body", 256))
        found = plain.drop("collides").unionByName(again.select("hash", "doc_id", "text_sha256", "keep_id", "group_size"))
    return found.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def exact_dedup(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay, with all their columns: one of each group of equal texts. Of rows that repeat the id that stays, and of a group
    of null ids alone, any one stays. Rows are told by id and text, so null ids are judged by their groups too."""
    kept = exact_groups(docs).filter("kept").select(F.col("doc_id").alias("_kept"), "text_sha256").distinct().hint("shuffle_hash")
    own = next(name for k in range(len(docs.columns) + 1) if (name := "_" * k + "sha") not in docs.columns)
    rows = docs.withColumn(own, F.sha2(normalised(), 256))
    same = rows["doc_id"].eqNullSafe(kept["_kept"]) & (rows[own] == kept["text_sha256"])
    # the join has brought rows of one id and text together
    return rows.join(kept, same, "left_semi").dropDuplicates(["doc_id", own]).select(*docs.columns)


ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS body FROM documents),
g AS (SELECT body, min(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY body)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, sha256(d.body) AS text_sha256
FROM d JOIN g ON d.body = g.body
"""
