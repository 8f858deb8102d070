"""Connected components of edges of any number, by pointer jumping.

Every node points to the least node it knows of its component. In a round each node, and the node that it points to, take the least of what their neighbours' pointers
point to, and pointers jump to what they point to. Rounds grow with the logarithm of the longest path; each is written below the shared folder, so no
lineage builds up, and the folder of the round before is removed. Nothing is collected but whether a round changed anything."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemo.sources import shared


def components(edges: DataFrame, most_rounds: int = 200) -> tuple[DataFrame, int]:
    """edges: a, b, of one ordered type. node, component (the least node that can be reached) of every node with an edge, and how many rounds it took."""
    spark, root = edges.sparkSession, shared.folder(edges.sparkSession, "components")

    def put(name: str, df: DataFrame) -> DataFrame:
        df.write.parquet(f"{root}/{name}")
        return spark.read.schema(df.schema).parquet(f"{root}/{name}")

    both = edges.select("a", "b").filter("a <> b")
    both = put("edges", both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    now = put("parents-0", both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("a")).alias("parent")))
    for k in range(1, most_rounds + 1):
        above = now.select(F.col("node").alias("parent"), F.col("parent").alias("grand"))
        grand = put(f"grand-{k}", now.join(above, "parent").select("node", "parent", "grand"))
        other = grand.select(F.col("node").alias("b"), F.col("grand").alias("least"))
        own = grand.select(F.col("node").alias("a"), "parent")
        told = both.join(other, "b").groupBy("a").agg(F.min("least").alias("least")).join(own, "a")
        hooked = told.select(F.explode(F.array("a", "parent")).alias("node"), "least", F.lit(None).cast(now.schema["parent"].dataType).alias("old"))
        offers = hooked.unionByName(grand.select("node", F.col("grand").alias("least"), F.col("parent").alias("old")))
        new = put(f"parents-{k}", offers.groupBy("node").agg(F.min("least").alias("parent"), F.max("old").alias("old")))
        shared.drop(spark, f"{root}/grand-{k}", f"{root}/parents-{k - 1}")
        now = new.select("node", "parent")
        if new.filter("parent <> old").isEmpty():
            shared.drop(spark, f"{root}/edges")
            return now.select("node", F.col("parent").alias("component")), k
    raise RuntimeError(f"not settled after {most_rounds} rounds")
