"""k-means with bounds against every distance in Python's integers, and SQL."""

import hashlib
import math
import random
from fractions import Fraction

import duckdb
import numpy as np
import pytest

from mnemo.llm import clustering

from .conftest import SF

CLASH = "own v upper lower computed cluster distance cluster_inertia inertia centroid_sha256 label"


def brute(rows, k=40, rounds=5, width=64):
    """rows: vec_id, embedding; a sorted list of vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256."""
    kept = [(i, [math.floor(Fraction(x) * 256) for x in v]) for i, v in rows if v is not None and len(v) == width and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted((r for r in kept if r[0] is not None), key=lambda r: (hashlib.sha256(f"2:{r[0]}".encode()).hexdigest(), r[0], r[1]))[:k]
    centroids = [v for _, v in first]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(centroids))

    for _ in range(rounds):
        own = [nearest(v)[1] for _, v in kept]
        for j in range(len(centroids)):
            mine = [v for (_, v), o in zip(kept, own, strict=True) if o == j]
            if mine:
                centroids[j] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    last = [(i, *nearest(v)[::-1]) for i, v in kept] if centroids else []
    inertia = {}
    for _, j, d in last:
        inertia[j] = inertia.get(j, 0) + d
    fits = lambda x: x if x < 1 << 63 else None
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(((i, j, fits(d), fits(inertia[j]), fits(sum(inertia.values())), digest[j]) for i, j, d in last), key=str)


def frame(spark, rows, kind="float"):
    return spark.createDataFrame([(*r, *["x"] * 10) for r in rows], f"vec_id bigint, embedding array<{kind}>, " + ", ".join(f"{c} string" for c in CLASH.split() if c not in ("v", "label")) + ", v string")


def found(df, **how):
    return sorted((tuple(r)[:6] for r in clustering.kmeans(df, **how).collect()), key=str)


def test_equals_brute_force_on_the_table(spark):
    df = spark.read.parquet(f"{SF}/embeddings.parquet")
    assert found(df) == brute([(r.vec_id, r.embedding) for r in df.collect()])


def test_nulls_odd_vectors_ties_and_repeated_rows(spark):
    rng = np.random.default_rng(1)
    points = (rng.integers(-4, 5, (150, 64)) / 256).astype(np.float32)
    rows = [(i, p.tolist()) for i, p in enumerate(points)] + [(i, points[i % 9].tolist()) for i in range(200, 260)] + [(3, points[3].tolist())] * 3
    rows += [(None, points[5].tolist()), (900, None), (901, []), (902, [0.0] * 63), (903, [0.0] * 65), (904, [None] + [0.0] * 63), (905, [math.nan] + [0.0] * 63), (906, [math.inf] + [0.0] * 63), (907, [-math.inf] * 64)]
    df = frame(spark, rows).repartition(5)
    assert found(df) == brute(rows)
    assert found(df, k=3, rounds=2) == brute(rows, k=3, rounds=2)


@pytest.mark.parametrize("scale", [1e4, 1e12, 1e36])
def test_large_components_stay_exact(spark, scale):
    rng = np.random.default_rng(2)
    rows = [(i, (rng.standard_normal(64) * (scale if i % 3 else 1)).astype(np.float32).tolist()) for i in range(90)]
    assert found(frame(spark, rows), k=7, rounds=3) == brute([(i, v) for i, v in rows], k=7, rounds=3)


def test_fewer_vectors_than_centroids_and_none(spark):
    rows = [(i, [float(i)] * 64) for i in range(5)]
    assert found(frame(spark, rows)) == brute(rows)
    none = clustering.kmeans(frame(spark, rows).filter("false"))
    assert none.count() == 0 and none.columns[:6] == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert clustering.kmeans(frame(spark, [(None, [0.0] * 64)])).count() == 0


def test_bounds_skip_most_distances(spark):
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((40, 64)) * 5
    rows = [(i, (centres[i % 40] + rng.standard_normal(64) * 0.1).tolist()) for i in range(2000)]
    done = clustering.kmeans(frame(spark, rows, "double"))
    assert done.agg({"computed": "sum"}).first()[0] < 2000 * 40 / 10


def test_rounding_outwards():
    rng = random.Random(4)
    squares = np.array([float(rng.randrange(1 << rng.randrange(1, 52))) for _ in range(5000)])
    up, down = clustering._root(squares, True), clustering._root(squares, False)
    assert all(Fraction(float(u)) ** 2 >= Fraction(s) and Fraction(float(d)) ** 2 <= Fraction(s) for u, d, s in zip(up, down, squares, strict=True))


def test_sql_agrees(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{SF}/embeddings.parquet'")
    cur = con.execute(clustering.ORACLE)
    names = [c[0] for c in cur.description]
    order = [names.index(c) for c in ("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")]
    assert sorted((tuple(r[i] for i in order) for r in cur.fetchall()), key=str) == found(spark.read.parquet(f"{SF}/embeddings.parquet"))
