"""Connected components of an edge table by alternating large-star and small-star rounds.

Each round is a minimum per node (partial aggregation, so a hot node sends one row per task) joined back to the edges
(a sort-merge join that adaptive execution splits). Rounds grow with the logarithm of the component size; every round is
a written table, so no lineage builds up. Nothing is collected but one row of counts per round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemo.llm.common import Scratch


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges: u, v. Large star: v above u join the least neighbour of u; small star: those below do, and u itself."""
    if large:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    joined = both.join(least, "u")
    if large:
        out = joined.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.filter("u <> v").distinct()


def components(edges: DataFrame, scratch: Scratch, most_rounds: int = 60) -> DataFrame:
    """node, component (the least node reachable) for every node that has an edge. edges: u, v of one ordered type."""
    now, seen = scratch.put("edges-0", edges.select("u", "v").filter("u <> v").distinct()), None
    for k in range(1, most_rounds):
        now = scratch.put(f"edges-{k}", _star(_star(now, True), False))
        scratch.drop(f"edges-{k - 1}")
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        seen = state
    raise RuntimeError("components did not settle")
