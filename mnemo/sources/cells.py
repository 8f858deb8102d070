"""A coarse index of embeddings: cells around centroids, vectors laid out by cell, so that a search reads the cells nearest to its vector and no other.

Centroids come from spherical k-means over a sample of at most SAMPLE vectors (those whose ids hash lowest among all rows, VALUES numbers at most), so what the
driver holds is bounded; every vector is indexed, each in the cell of its nearest centroid by cosine. `vectors` lies by space, namespace and cell; `sizes` counts the
vectors of each cell by space and namespace. A search takes cells in order of distance until they hold enough vectors of its space and namespace, so a small namespace
is read whole. It offers ids; whether they are candidates still, and how far they are, the memories themselves tell (recall.vec_candidates_diagnosed), which
also makes the exact pass where an offer falls short. A memory embedded anew is appended in its new cell; its old row can only be offered in vain."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemo.functions import scoring, vectors
from mnemo.operators.predicates import Target, in_space, in_target

#: Vectors and numbers that centroids are fitted on at most; rounds; vectors read for each row of the pool, at least.
SAMPLE, VALUES, ROUNDS, READ = 20_000, 8_000_000, 8, 20
OWNER = "memory_space_id string, namespace string, scope_kind string, scope_ref string, memory_id string"


def _unit(x: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(norm > 0, norm, 1)


def centroids(sample: np.ndarray, cells: int, rounds: int = ROUNDS) -> np.ndarray:
    """Spherical k-means from every (n / cells)-th vector in order of the sample; an empty cell keeps its centroid."""
    x = _unit(sample.astype(np.float64))
    at = x[np.linspace(0, len(x) - 1, min(cells, len(x))).astype(int)]
    for _ in range(rounds):
        own = (x @ at.T).argmax(1)
        sums = np.zeros_like(at)
        np.add.at(sums, own, x)
        full = np.bincount(own, minlength=len(at)) > 0
        at = np.where(full[:, None], _unit(sums), at)
    return at.astype(np.float32)


class CellIndex:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _embedded(self, memories: DataFrame) -> DataFrame:
        sound = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))) & (F.size("embedding") > 0)
        return memories.filter(F.col("embedding").isNotNull() & sound).select("memory_space_id", "namespace", "scope_kind", "scope_ref", "memory_id", F.col("embedding").cast("array<float>").alias("embedding"))

    def build(self, memories: DataFrame, cells: int | None = None) -> CellIndex:
        """Fits the centroids and lays out all vectors. cells: the square root of their number unless given."""
        rows = self._embedded(memories)
        n, width = rows.agg(F.count("*"), F.max(F.size("embedding"))).first()
        most = max(1, min(SAMPLE, VALUES // max(1, width or 1)))
        sample = rows.filter(F.size("embedding") == (width or 0)).orderBy(F.xxhash64("memory_id"), "memory_id").limit(most).select("embedding").toPandas().embedding
        cells = cells or max(1, min(4096, math.isqrt(n)))
        at = centroids(np.array(sample.tolist(), np.float32), cells) if n else np.zeros((0, 0), np.float32)
        table = [(i, [float(v) for v in c]) for i, c in enumerate(at)]
        self.spark.createDataFrame(table, "cell int, centroid array<float>").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/centroids")
        self._lay_out(rows, at)
        return self

    def update(self, memories: DataFrame) -> None:
        """Appends new or changed memories by the centroids there are."""
        self._lay_out(self._embedded(memories), self.centroids())

    def centroids(self) -> np.ndarray:
        rows = self.spark.read.schema("cell int, centroid array<float>").parquet(f"{self.path}/centroids").orderBy("cell").collect()
        return np.array([r.centroid for r in rows], np.float32)

    def vectors(self) -> DataFrame:
        return self.spark.read.schema(f"{OWNER}, embedding array<float>, cell int").parquet(f"{self.path}/vectors")

    def _lay_out(self, rows: DataFrame, at: np.ndarray) -> None:
        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                cell = []
                for start in range(0, batch.num_rows, 2048):
                    x = [v if len(v) == at.shape[1] else [0.0] * at.shape[1] for v in batch.column("embedding").slice(start, 2048).to_pylist()]
                    cell.append((_unit(np.array(x, np.float64)) @ at.T.astype(np.float64)).argmax(1))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate(cell), pa.int32())], [*batch.schema.names, "cell"])

        if not len(at):
            placed = rows.withColumn("cell", F.lit(0))
        else:
            placed = rows.mapInArrow(work, f"{OWNER}, embedding array<float>, cell int")
        parts = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        # by cell and a salt of the id: a crowded cell is several files
        dealt = placed.repartition(parts, "memory_space_id", "namespace", "cell", F.pmod(F.xxhash64("memory_id"), F.lit(max(1, parts // 8))))
        dealt.write.mode("append").partitionBy("memory_space_id", "namespace", "cell").parquet(f"{self.path}/vectors")

    def sizes(self, space: str, target: Target) -> dict[int, int]:
        """How many vectors each cell has of the target's namespace: at most a row a cell, counted from partitions."""
        namespace = target.scope.namespace if hasattr(target, "scope") else target.namespace
        rows = self.vectors().filter(in_space(space) & (F.col("namespace") == namespace)).groupBy("cell").count().collect()
        return {r["cell"]: r["count"] for r in rows}

    def nearest(self, space: str, target: Target, vector: list[float], read: int) -> list[int]:
        """The cells to open."""
        at, held = self.centroids(), self.sizes(space, target)
        if not len(at):
            return sorted(held)
        order = np.argsort(-(at.astype(np.float64) @ _unit(np.array([vector], np.float64))[0]), kind="stable").tolist()
        found, seen = [], 0
        for cell in order:
            if seen >= read:
                break
            if held.get(cell):
                found.append(cell)
                seen += held[cell]
        return found

    def offer(self, space: str, target: Target, vector: list[float], pool: int = scoring.POOL, read: int = READ) -> DataFrame:
        """memory_id of the nearest vectors of the target in the cells opened: twice the pool, as some may be no candidates any more."""
        cells = self.nearest(space, target, vector, pool * read)
        rows = self.vectors().filter(in_space(space) & in_target(target) & F.col("cell").isin(cells))
        distance = vectors.cosine_distance(F.col("embedding"), vectors.literal(vector))
        near = rows.select("memory_id", distance.alias("distance")).filter("distance IS NOT NULL")
        return near.orderBy("distance", "memory_id").limit(2 * pool).select("memory_id")
