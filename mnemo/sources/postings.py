"""An inverted index of English full text, as Parquet in buckets of lexemes.

`postings` has a row for each memory and lexeme: the places of the lexeme, the memory's space, scope and time. Its files lie by bucket (a hash of the
lexeme), sorted by lexeme, so a search opens the buckets of its lexemes and no other, and skips row groups in them. `entries` has a slim row for each state of
a memory: its content's key and whether it is active; the latest counts. An update appends: postings for contents that are not indexed yet, entries for all.
Postings whose content is no longer the memory's own are left behind by a search, and `compact` leaves them out for good. Postings are written first, so what stops
between the two changes nothing that a search sees; repeating the update is harmless, as equal postings count once.

A lexeme of a third of all memories fills its bucket with many files, read by many tasks. Nothing is collected but the number of the last update."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mnemo.functions import scoring, text
from mnemo.functions.english import Stems
from mnemo.operators.predicates import Target, in_space, in_target

BUCKETS = 64
OWNER = "memory_space_id string, namespace string, scope_kind string, scope_ref string, memory_id string, content_key bigint, created_at timestamp"
POSTINGS = f"{OWNER}, lexeme string, places array<int>, bucket int"
ENTRIES = "memory_space_id string, namespace string, scope_kind string, scope_ref string, memory_id string, content_key bigint, created_at timestamp, active boolean, turn bigint"
OWN = ["memory_space_id", "namespace", "scope_kind", "scope_ref", "memory_id", "content_key", "created_at"]


def _bucket(lexeme: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(lexeme), F.lit(buckets)).cast("int")


class FullTextIndex:
    """The index in a folder; `buckets` stays what it was when the index was begun."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS, simple: bool = False):
        self.spark, self.path, self.buckets, self.simple = spark, path, buckets, simple

    def _there(self, name: str) -> bool:
        where = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}/_SUCCESS")
        return where.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(where)

    def postings(self) -> DataFrame:
        if not self._there("postings"):
            return self.spark.createDataFrame([], POSTINGS)
        return self.spark.read.schema(POSTINGS).parquet(f"{self.path}/postings")

    def entries(self) -> DataFrame:
        """Every state of every memory."""
        if not self._there("entries"):
            return self.spark.createDataFrame([], ENTRIES)
        return self.spark.read.schema(ENTRIES).parquet(f"{self.path}/entries")

    def _turn(self) -> int:
        return (self.entries().agg(F.max("turn")).first()[0] or 0) + 1

    def update(self, memories: DataFrame) -> None:
        """memories: rows as they are now, one an id, new or changed ones at least."""
        turn = self._turn()
        rows = memories.withColumn("content_key", F.xxhash64("content"))
        known = self.entries().select("memory_id", "content_key").distinct()
        self._post(rows.join(known, ["memory_id", "content_key"], "left_anti"))
        entries = rows.select(*OWN, (F.col("status") == "active").alias("active"), F.lit(turn).alias("turn"))
        self._enter(entries)

    def remove(self, ids: DataFrame) -> None:
        """ids: memory_id; they are found no more."""
        last = self.latest().join(ids.select("memory_id").distinct(), "memory_id", "left_semi")
        self._enter(last.select(*OWN, F.lit(False).alias("active"), F.lit(self._turn()).alias("turn")))

    def _enter(self, entries: DataFrame) -> None:
        entries.write.mode("append").partitionBy("memory_space_id", "namespace").parquet(f"{self.path}/entries")

    def _post(self, rows: DataFrame) -> None:
        simple = self.simple

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            stems = None if simple else Stems()
            for batch in batches:
                for start in range(0, batch.num_rows, 256):
                    part = batch.slice(start, 256)
                    row, lexeme, where = [], [], []
                    for i, content in enumerate(part.column("content").to_pylist()):
                        for x, at in text.places(content or "", stems).items():
                            row.append(i)
                            lexeme.append(x)
                            where.append(at)
                    take = pa.array(row, pa.int32())
                    yield pa.RecordBatch.from_arrays([*(part.column(c).take(take) for c in OWN), pa.array(lexeme, pa.string()), pa.array(where, pa.list_(pa.int32()))], [*OWN, "lexeme", "places"])

        made = rows.select(*OWN, "content").mapInArrow(work, f"{OWNER}, lexeme string, places array<int>").withColumn("bucket", _bucket(F.col("lexeme"), self.buckets))
        self._store(made, f"{self.path}/postings")

    def _store(self, postings: DataFrame, path: str) -> None:
        parts = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        # a bucket goes to several tasks, by a salt of the memory, so a hot lexeme is split
        dealt = postings.repartition(parts, "bucket", F.pmod(F.xxhash64("memory_id"), F.lit(max(1, parts // 8)))).sortWithinPartitions("bucket", "lexeme", "memory_id")
        dealt.write.mode("append").partitionBy("bucket").parquet(path)

    def latest(self, bound: Column | None = None) -> DataFrame:
        """The last state of each memory (scope and space of a memory don't change, so they can be bound before)."""
        states = self.entries() if bound is None else self.entries().filter(bound)
        state = F.struct(*[F.col(c) for c in (*OWN, "active")])
        return states.groupBy("memory_id").agg(F.max_by(state, "turn").alias("s")).select("s.*")

    def search(self, space: str, target: Target, query: str | None, pool: int = scoring.POOL) -> DataFrame:
        """memory_id, fts_rank, fts_score: what recall.fts_candidates gives for the memories of the last update."""
        clauses = text.parse(query, self.simple)
        wanted = text.lexemes(clauses)
        bound = in_space(space) & in_target(target)
        now = self.latest(bound).filter("active").select("memory_id", "content_key", "created_at")
        buckets = [r[0] for r in self.spark.range(1).select(F.explode(F.array(*[_bucket(F.lit(x), self.buckets) for x in wanted]))).collect()] if wanted else []
        some = self.postings().filter(F.col("bucket").isin(buckets) & F.col("lexeme").isin(wanted) & bound)
        none = F.array().cast("array<int>")
        at = F.array(*[F.coalesce(F.max(F.when(F.col("lexeme") == x, F.col("places"))), none) for x in wanted]) if wanted else F.array(none)
        found = some.groupBy("memory_id", "content_key").agg(at.alias("at"))
        if text.needs_any(clauses):
            rows = now.join(found, ["memory_id", "content_key"])
        else:
            rows = now.join(found, ["memory_id", "content_key"], "left").withColumn("at", F.coalesce("at", F.array_repeat(none, max(1, len(wanted)))))
        hits = rows.filter(text.matches(F.col("at"), clauses)).select("memory_id", "created_at", text.rank(F.col("at"), clauses).alias("fts_score"))
        order = [F.desc("fts_score"), F.desc("created_at"), F.asc("memory_id")]
        best = hits.orderBy(*order).limit(pool)
        return best.withColumn("fts_rank", F.row_number().over(Window.orderBy(*order))).select("memory_id", "fts_rank", "fts_score")

    def compact(self, path: str) -> FullTextIndex:
        """The same index in another folder, with the last states and their postings alone."""
        out = FullTextIndex(self.spark, path, self.buckets, self.simple)
        last = self.latest()
        current = last.filter("active").select("memory_id", "content_key")
        out._store(self.postings().join(current, ["memory_id", "content_key"], "left_semi").dropDuplicates(["memory_id", "lexeme"]).select(*OWN, "lexeme", "places", "bucket"), f"{path}/postings")
        out._enter(last.filter("active").withColumn("turn", F.lit(1)))
        return out
