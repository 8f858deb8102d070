"""The full-text index and the cell index against reads of the memories themselves."""

import math
import re
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from mnemo.operators import recall
from mnemo.operators.predicates import ExactScope, NamespaceWide, Scope
from mnemo.operators.recall import explained
from mnemo.plans.recall_plan import RecallPlan
from mnemo.sources.cells import CellIndex, centroids
from mnemo.sources.postings import FullTextIndex

COLUMNS = "memory_space_id string, memory_id string, agent_id string, session_id string, namespace string, scope_kind string, scope_ref string, memory_type string, content string, priority int, confidence string, tags array<string>, status string, created_at timestamp, embedding array<float>"
QUERIES = ["cats", "running dog", '"big dog" or bird', "dog -cat", "-cat", '"the big of dogs"', "", "the", "dogs OR -bird", '-"big dog" cat', "no such word"]


def memory(i, content, status="active", space="a", scope=(None, None), embedding=None, namespace="n"):
    return (space, f"m{i:05d}", "bob", None, namespace, *scope, "fact", content, i % 100, "high", [], status, datetime(2024, 1, 1) + timedelta(hours=i), embedding)


def table(spark, rows):
    return spark.createDataFrame(rows, COLUMNS)


TEXTS = ["The big dog runs after cats", "a cat and a dog", "birds running", "big of dogs, big dogs", "", "the the the", "Dog! dog? DOG", "nothing here", None, "dogged running cat " * 400, "big dog the cat ran"]


@pytest.fixture(scope="module")
def memories(spark):
    rows = [memory(i, TEXTS[i % len(TEXTS)], "archived" if i % 6 == 5 else "active", "ab"[i % 7 == 6], ("repo", "web") if i % 3 else (None, None)) for i in range(110)]
    return table(spark, rows).cache()


def both(index, memories, target, query, pool=20):
    found = [tuple(r) for r in index.search("a", target, query, pool).orderBy("fts_rank").collect()]
    read = [tuple(r) for r in recall.fts_candidates(memories, "a", target, query, pool).orderBy("fts_rank").collect()]
    return found, read


@pytest.mark.parametrize("query", QUERIES)
@pytest.mark.parametrize("target", [NamespaceWide("n"), ExactScope(Scope("n")), ExactScope(Scope("n", "repo", "web"))], ids=["wide", "global", "entity"])
def test_index_answers_as_the_texts_do(index_of, memories, query, target):
    found, read = both(index_of, memories, target, query)
    assert found == read
    assert bool(found) == (query not in ("", "the", "no such word"))


@pytest.fixture(scope="module")
def index_of(spark, memories, tmp_path_factory):
    index = FullTextIndex(spark, str(tmp_path_factory.mktemp("postings")), buckets=8)
    index.update(memories)
    return index


def test_changes_removals_and_repeated_updates(spark, memories, tmp_path):
    index = FullTextIndex(spark, str(tmp_path / "a"), buckets=4)
    index.update(memories.withColumn("content", F.concat(F.lit("bird "), F.coalesce("content", F.lit("")))))
    now = memories.withColumn("status", F.when(F.col("memory_id") < "m00020", "archived").otherwise(F.col("status")))
    index.update(now)
    index.update(now.limit(30))
    gone = now.filter("memory_id LIKE '%3'").select("memory_id")
    index.remove(gone)
    left = now.join(gone, "memory_id", "left_anti")
    for query in ("bird", "dog", "-cat"):
        found, read = both(index, left, NamespaceWide("n"), query)
        assert found == read and found
    small = index.compact(str(tmp_path / "b"))
    assert small.postings().count() < index.postings().count()
    found, read = both(small, left, NamespaceWide("n"), "dog")
    assert found == read
    index.update(now.filter("memory_id LIKE '%3'"))
    found, read = both(index, now, NamespaceWide("n"), "dog")
    assert found == read


def test_an_index_of_nothing(spark, memories, tmp_path):
    index = FullTextIndex(spark, str(tmp_path / "i"))
    assert index.search("a", NamespaceWide("n"), "dog").count() == 0
    index.update(memories.filter("false"))
    assert index.search("a", NamespaceWide("n"), "dog").count() == 0


def test_a_search_opens_the_buckets_of_its_lexemes_only(index_of):
    plan = explained(index_of.search("a", NamespaceWide("n"), "dog"))
    assert re.search(r"PartitionFilters: \[[^\]]*bucket", plan)
    assert re.search(r"PushedFilters: \[[^\]]*EqualTo\(lexeme,dog\)|PushedFilters: \[[^\]]*In\(lexeme, \[dog\]\)", plan)
    assert "Python" not in plan and "MapInArrow" not in plan


def test_recall_by_the_index_is_recall(index_of, memories):
    now = datetime(2024, 2, 1)
    plan = RecallPlan(keyword=True, vector=False, embed=False)
    one = recall.execute(memories, "a", NamespaceWide("n"), "dogs", None, plan, now).select("memory_id", "score").collect()
    assert one == recall.execute(memories, "a", NamespaceWide("n"), "dogs", None, plan, now, index=index_of).select("memory_id", "score").collect() and one


def at(angle, width=8):
    return [math.cos(angle), math.sin(angle)] + [0.0] * (width - 2)


def corpus(spark, inside, times):
    """In scope between 0.8 and 1.2 rad, decoys of another scope between 0.05 and 0.5, nearer to the query at 0."""
    rows = [memory(i, "x", scope=("repo", "in"), embedding=at(0.8 + 0.4 * i / inside)) for i in range(inside)]
    rows += [memory(inside + i, "x", scope=("repo", "decoy"), embedding=at(0.05 + 0.45 * i / (inside * times))) for i in range(inside * times)]
    return table(spark, rows)


@pytest.mark.parametrize("inside,times", [(200, 1), (200, 10), (2000, 0), (2000, 1), (2000, 10)])
def test_recall_on_the_decoy_grid(spark, tmp_path, inside, times):
    m = corpus(spark, inside, times).cache()
    index = CellIndex(spark, str(tmp_path / "cells")).build(m)
    target = ExactScope(Scope("n", "repo", "in"))
    truth = [f"m{i:05d}" for i in range(10)]
    outcome, rows = recall.vec_candidates_diagnosed(m, "a", target, at(0.0), index.offer("a", target, at(0.0)))
    assert [r.memory_id for r in rows.orderBy("vec_rank").limit(10).collect()] == truth
    assert outcome.rows == 50 and outcome.starved == outcome.exact_fallback
    # the cells of decoys are nearer, and hold all that is read first
    assert outcome.exact_fallback == (inside * times >= 1000)
    wide, rows = recall.vec_candidates_diagnosed(m, "a", NamespaceWide("n"), at(0.0), index.offer("a", NamespaceWide("n"), at(0.0)))
    exact = recall.vec_candidates(m, "a", NamespaceWide("n"), at(0.0)).filter("vec_rank <= 10").select("memory_id").withColumn("position", F.lit(1))
    assert not wide.exact_fallback and recall.recall_at_k(rows, exact, 10).first().recall >= 0.9
    m.unpersist()


def test_recall_without_fallback_on_random_vectors(spark, tmp_path):
    import numpy as np

    rng = np.random.default_rng(1)
    centres = rng.standard_normal((30, 16))
    m = table(spark, [memory(i, "x", embedding=(centres[i % 30] + 0.5 * rng.standard_normal(16)).tolist()) for i in range(6000)]).cache()
    index = CellIndex(spark, str(tmp_path / "cells")).build(m)
    assert index.vectors().count() == 6000
    found = 0
    for k in range(12):
        vector = (centres[k] + 0.5 * rng.standard_normal(16)).tolist()
        outcome, rows = recall.vec_candidates_diagnosed(m, "a", NamespaceWide("n"), vector, index.offer("a", NamespaceWide("n"), vector))
        assert not outcome.exact_fallback
        assert len(index.nearest("a", NamespaceWide("n"), vector, 1000)) < len(index.centroids()) / 2
        exact = {r.memory_id for r in recall.vec_candidates(m, "a", NamespaceWide("n"), vector).filter("vec_rank <= 10").collect()}
        found += len(exact & {r.memory_id for r in rows.filter("vec_rank <= 10").collect()})
    assert found >= 0.9 * 120
    m.unpersist()


def test_changed_vectors_and_none(spark, tmp_path):
    rows = [memory(i, "x", embedding=at(0.01 * i)) for i in range(100)] + [memory(100, "x"), memory(101, "x", embedding=[])]
    index = CellIndex(spark, str(tmp_path / "cells")).build(table(spark, rows))
    moved = table(spark, [memory(99, "x", embedding=at(0.001))])
    index.update(moved)
    now = table(spark, rows[:99]).unionByName(moved)
    outcome, best = recall.vec_candidates_diagnosed(now, "a", NamespaceWide("n"), at(0.0), index.offer("a", NamespaceWide("n"), at(0.0)))
    assert [r.memory_id for r in best.orderBy("vec_rank").limit(2).collect()] == ["m00000", "m00099"] and not outcome.exact_fallback
    empty = CellIndex(spark, str(tmp_path / "none")).build(table(spark, [memory(1, "x")]))
    assert recall.vec_candidates_diagnosed(now, "a", NamespaceWide("n"), at(0.0), empty.offer("a", NamespaceWide("n"), at(0.0)))[0].approximate_rows == 0


def test_a_search_opens_its_cells_only(spark, tmp_path):
    m = corpus(spark, 400, 1)
    index = CellIndex(spark, str(tmp_path / "cells")).build(m)
    assert re.search(r"PartitionFilters: \[[^\]]*cell", explained(index.offer("a", NamespaceWide("n"), at(0.0), pool=2, read=5)))


def test_centroids_of_few_vectors():
    import numpy as np

    assert centroids(np.array([[1.0, 0], [0, 2.0]]), 9).shape == (2, 2)
