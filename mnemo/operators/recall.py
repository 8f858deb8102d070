"""Recall: a full-text and a vector channel, each cut to a pool, fused by reciprocal rank with recency, priority and confidence.

Candidates are filtered before they are ranked, so the vector channel is exact. Each channel ranks slim rows (id and score) by a top-k
that every task computes on its own part; only the pool's rows fetch their payload."""

from __future__ import annotations

import contextlib
import io
from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnemo.functions import scoring, text, vectors
from mnemo.operators.predicates import Scope, Target, candidates, legacy_target
from mnemo.operators.reads import RECORD_COLUMNS
from mnemo.plans.recall_plan import RecallPlan, capability, plan_recall, result_limit
from mnemo.sources.postings import FullTextIndex


def _top(rows: DataFrame, order: list[Column], rank: str, pool: int) -> DataFrame:
    """rank counts from 1; the window sees the pool only."""
    return rows.orderBy(*order).limit(pool).withColumn(rank, F.row_number().over(Window.orderBy(*order)))


def fts_candidates(memories: DataFrame, space: str, target: Target, query: str | None, pool: int = scoring.POOL) -> DataFrame:
    """memory_id, fts_rank, fts_score, from the texts themselves; sources.postings answers the same from an index."""
    clauses = text.parse(query)
    rows = text.located(candidates(memories, space, target).select("memory_id", "created_at", "content"), text.lexemes(clauses))
    scored = rows.filter(text.matches(F.col("at"), clauses)).select("memory_id", "created_at", text.rank(F.col("at"), clauses).alias("fts_score"))
    return _top(scored, [F.desc("fts_score"), F.desc("created_at"), F.asc("memory_id")], "fts_rank", pool).select("memory_id", "fts_rank", "fts_score")


def vec_candidates(memories: DataFrame, space: str, target: Target, vector: list[float], pool: int = scoring.POOL) -> DataFrame:
    """memory_id, vec_rank, distance; exact."""
    rows = candidates(memories, space, target).filter(F.col("embedding").isNotNull())
    scored = rows.select("memory_id", F.round(vectors.cosine_distance(F.col("embedding"), vectors.literal(vector)), 9).alias("distance")).filter("distance IS NOT NULL")
    return _top(scored, [F.asc("distance"), F.asc("memory_id")], "vec_rank", pool)


@dataclass(frozen=True)
class VectorOutcome:
    """Of a channel with an approximate first pass."""

    approximate_rows: int
    exact_fallback: bool
    rows: int

    @property
    def starved(self) -> bool:
        return self.exact_fallback and self.rows > self.approximate_rows


def vec_candidates_diagnosed(memories: DataFrame, space: str, target: Target, vector: list[float], approximate: DataFrame, pool: int = scoring.POOL) -> tuple[VectorOutcome, DataFrame]:
    """approximate: rows (memory_id) that an index offers. If fewer than a pool of them are candidates, the exact pass replaces them."""
    offered = vec_candidates(memories.join(approximate.select("memory_id").distinct(), "memory_id", "left_semi"), space, target, vector, pool)
    n = offered.count()
    if n >= pool:
        return VectorOutcome(n, False, n), offered
    exact = vec_candidates(memories, space, target, vector, pool)
    return VectorOutcome(n, True, exact.count()), exact


def fuse(fts: DataFrame | None, vec: DataFrame | None, memories: DataFrame, space: str, now: datetime) -> DataFrame:
    """The records of both channels with their ranks and score, best first, ties by id."""
    if fts is not None and vec is not None:
        ranks = fts.select("memory_id", "fts_rank").join(vec.select("memory_id", "vec_rank"), "memory_id", "full")
    elif fts is not None:
        ranks = fts.select("memory_id", "fts_rank", F.lit(None).cast("int").alias("vec_rank"))
    else:
        ranks = vec.select("memory_id", F.lit(None).cast("int").alias("fts_rank"), "vec_rank")
    # at most two pools of ids, a bound known before it runs
    rows = memories.filter(F.col("memory_space_id") == space).select(*RECORD_COLUMNS).join(F.broadcast(ranks), "memory_id")
    score = scoring.blend(F.col("fts_rank"), F.col("vec_rank"), F.col("created_at"), F.col("priority"), F.col("confidence"), F.lit(now).cast("timestamp"))
    return rows.withColumn("score", F.round(score, 9)).orderBy(F.desc("score"), F.asc("memory_id"))


def apply_budgets(hits: DataFrame, per_memory: int = scoring.PER_MEMORY, total: int = scoring.TOTAL) -> DataFrame:
    """Contents cut to per_memory; the hits before the first that would exceed total. hits: a limited number of rows with score."""
    if total <= 0:
        return hits.limit(0)
    cut = hits.withColumn("content", scoring.truncated(F.col("content"), per_memory))
    upto = Window.orderBy(F.desc("score"), F.asc("memory_id")).rowsBetween(Window.unboundedPreceding, 0)
    return cut.withColumn("_sum", F.sum(F.length("content")).over(upto)).filter(F.col("_sum") <= total).drop("_sum")


def execute(
    memories: DataFrame, space: str, target: Target, query: str | None, vector: list[float] | None, plan: RecallPlan, now: datetime, limit: int = scoring.LIMIT, per_memory: int = scoring.PER_MEMORY, total: int = scoring.TOTAL,
    index: FullTextIndex | None = None,
) -> DataFrame:
    """index: where the keyword channel looks, if there is one; without, it splits the candidates' texts."""
    keyword = (lambda: index.search(space, target, query)) if index is not None else (lambda: fts_candidates(memories, space, target, query))
    fts = keyword() if plan.keyword else None
    vec = vec_candidates(memories, space, target, vector) if plan.vector and vector is not None else None
    if fts is None and vec is None:
        fts = keyword()
    best = fuse(fts, vec, memories, space, now).limit(limit)
    return apply_budgets(best, per_memory, total)


def recall(memories: DataFrame, space: str, target: Target, query: str, now: datetime, strategy: str = "hybrid", limit: int = scoring.LIMIT, embed: Callable[[str], list[float]] | None = None, dimensions: int | None = None, index: FullTextIndex | None = None) -> DataFrame:
    """Hits with fts_rank, vec_rank and score. A missing vector capability or a failing embedder leaves the keyword channel."""
    plan, vector = plan_recall(capability(memories, dimensions), strategy), None
    if plan.embed and embed is not None:
        try:
            vector = embed(query)
        except Exception:  # the provider's failure must not fail the read
            plan = RecallPlan(keyword=True, vector=False, embed=False)
    elif plan.embed:
        plan = RecallPlan(keyword=True, vector=False, embed=False)
    return execute(memories, space, target, query, vector, plan, now, result_limit(limit), index=index)


def legacy_recall(memories: DataFrame, own_space: str, space: str, scope: Scope, query: str, now: datetime, limit: int, **more) -> DataFrame:
    """The older interface: a foreign space is an error before the limit is looked at, no limit gives nothing, a high one is cut."""
    if space != own_space:
        raise PermissionError(f"space {space} is not {own_space}")
    if limit <= 0:
        return memories.select(*RECORD_COLUMNS).limit(0)
    return recall(memories, space, legacy_target(scope), query, now, limit=min(limit, scoring.LIMIT_MOST), **more)


def recall_at_k(result: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    """found, wanted, recall: how many of the k true ids are among the result's ids."""
    best = truth.orderBy("position").limit(k).select("memory_id")
    found = best.join(result.select("memory_id").distinct(), "memory_id", "left_semi")
    return found.agg(F.count("*").alias("found")).crossJoin(best.agg(F.count("*").alias("wanted"))).withColumn("recall", F.when(F.col("wanted") > 0, F.col("found") / F.col("wanted")))


def explained(hits: DataFrame) -> str:
    """The plan of the very DataFrame that a recall returned."""
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        hits.explain("formatted")
    return out.getvalue()
