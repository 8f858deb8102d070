"""Operator 13, k-means in exact integers with Elkan's bounds.

Every vector carries the number of its centroid, an upper bound on the distance to it and k lower bounds on the distances to all. When centroids
move, the bounds move by as much; a distance is computed only where neither the lower bound nor half the distance between two centroids tells that
the centroid is farther. Bounds are rounded outwards (upper ones up, lower ones down, after each operation) and prune only what is strictly
farther, so ties are always computed, in exact integers, and go to the smaller number. `computed` counts them by row.

Each pass reads the vectors with their bounds and writes them anew below spark.checkpoint.dir (a lost executor costs a reread of one pass); tasks see
one Arrow batch at a time. Centroids (k rows of bounded width) go to the tasks in the closure. Sums by centroid are made per task, so a cluster
of any share of the rows sends k rows a task; nothing else is shuffled, and only k centroids and k sums ever reach the driver.

Integers of any size are exact: batches with components of 2^22 or more leave the float64 products for Python's integers, and sums travel in limbs.

Defined cases: vectors that are null, of another length, or have a null, NaN or infinite component are left out; rows with a null id are clustered
but start no centroid; repeated rows each get a row (and may start two equal centroids, of which the smaller number gets all); fewer vectors than k
start as many centroids as there are; an empty table gives an empty result; distance (and the sums of it) is null where it exceeds a long; further
columns are left aside."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemo.llm.common import Scratch, tidy

#: Products of components below this are exact in float64, and so are their sums over 64 components.
EXACT = 1 << 22
#: Sums travel as signed limbs of so many bits.
LIMB = 40
LONG = (1 << 63) - 1
Ints = np.ndarray


def _wide(x: Ints) -> bool:
    """Whether products need Python's integers; such arrays have the type object."""
    return x.dtype == object


def _as_ints(x: Ints, scale: int) -> Ints:
    """floor(scale * x) of finite float64; of Python's integers where some are large."""
    scaled = np.floor(x * scale)
    if np.isfinite(scaled).all() and (not scaled.size or np.abs(scaled).max() < EXACT):
        return scaled
    return np.array([[int(np.floor(v)) * scale if abs(v) >= 1 << 53 else int(np.floor(v * scale)) for v in row] for row in x.tolist()], object).reshape(x.shape)


def _matrix(points: list[list[int]]) -> Ints:
    if all(abs(v) < EXACT for row in points for v in row):
        return np.array(points, np.float64)
    return np.array(points, object)


def _squared(x: Ints, c: Ints) -> Ints:
    """Exact squared distances of rows of x to the one centroid c, or row by row."""
    if _wide(x) or _wide(c):
        d = x.astype(object) - c
        if not _wide(x):
            d = np.array([[int(v) for v in row] for row in d.tolist()], object).reshape(d.shape)
        return (d * d).sum(1) if len(d) else np.zeros(0, object)
    d = x - c
    return np.einsum("ij,ij->i", d, d)


def _root(squared: Ints, up: bool) -> np.ndarray:
    """The square root, rounded outwards to float32."""
    r = np.sqrt(squared.astype(np.float64))
    r = np.nextafter(np.nextafter(r, np.inf if up else 0), np.inf if up else 0)  # an integer beyond 2^53 was rounded too
    with np.errstate(over="ignore"):  # infinity is a bound too
        f = r.astype(np.float32)
    off = f < r if up else f > r
    return np.where(off, np.nextafter(f, np.float32(np.inf if up else 0)), f)


def _moved(bound: np.ndarray, by: np.ndarray, up: bool) -> np.ndarray:
    """bound + by rounded up, or bound - by rounded down, at least 0; float32."""
    if up:
        return np.nextafter(bound + by, np.float32(np.inf))
    return np.maximum(np.nextafter(bound - by, np.float32(-np.inf)), np.float32(0))


class Round:
    """What a pass needs to know of the centroids: where they are, how far they moved, how far they are from one another."""

    def __init__(self, now: list[list[int]], before: list[list[int]] | None):
        self.at = _matrix(now)
        k = len(now)
        self.first = before is None
        self.shift = np.zeros(k, np.float32) if before is None else _root(_squared(self.at, _matrix(before)), True)
        between = np.stack([_root(_squared(self.at, self.at[j]), False) for j in range(k)]) if k else np.zeros((0, 0), np.float32)
        self.half = np.nextafter(between / np.float32(2), np.float32(0)).astype(np.float32)
        np.fill_diagonal(self.half, np.inf)
        self.near = self.half.min(1) if k > 1 else np.full(k, np.inf, np.float32)


def assign(x: Ints, own: np.ndarray, upper: np.ndarray, lower: np.ndarray, c: Round) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The nearest centroid of each row, new bounds, and how many distances were computed for it. `own`, `upper`, `lower` are of the centroids before."""
    n, k = len(x), len(c.at)
    own = own.copy()
    if not c.first:
        upper = _moved(upper, c.shift[own], True)
        lower = _moved(lower, c.shift[None, :], False)
    else:
        upper, lower = np.full(n, np.inf, np.float32), np.zeros((n, k), np.float32)
    open_ = np.flatnonzero(~(upper < c.near[own]))
    computed = np.zeros(n, np.int32)
    if not len(open_):
        return own, upper, lower, computed
    xs, mine, up, low = x[open_], own[open_], upper[open_], lower[open_]
    # rows that a bound leaves open get their own distance, exactly
    doubtful = ((np.arange(k)[None, :] != mine[:, None]) & ~(low > up[:, None]) & ~(c.half[mine] > up[:, None])).any(1)
    rows = np.flatnonzero(doubtful)
    xs, mine_, up_, low_ = xs[rows], mine[rows], up[rows], low[rows]
    best = _squared(xs, c.at[mine_])
    computed[open_[rows]] += 1
    up_ = _root(best, True)
    low_[np.arange(len(rows)), mine_] = _root(best, False)
    for j in range(k):
        look = np.flatnonzero((mine_ != j) & ~(low_[:, j] > up_) & ~(c.half[mine_, j] > up_))
        if not len(look):
            continue
        d = _squared(xs[look], c.at[j])
        computed[open_[rows[look]]] += 1
        low_[look, j] = _root(d, False)
        wins = (d < best[look]) | ((d == best[look]) & (j < mine_[look]))
        won = look[wins.astype(bool)]
        best[won], mine_[won] = d[wins.astype(bool)], j
        up_[won] = _root(best[won], True)
    mine[rows], up[rows], low[rows] = mine_, up_, low_
    own[open_], upper[open_], lower[open_] = mine, up, low
    return own, upper, lower, computed


def _lists(x: np.ndarray, kind: pa.DataType) -> pa.Array:
    n, width = x.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * width, pa.int32()), pa.array(x.reshape(-1), kind))


def _flat(column: pa.Array, width: int, kind: type) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind, copy=False).reshape(len(column), width)


def _ints(column: pa.Array, width: int, scale: int) -> Ints:
    return _as_ints(_flat(column, width, np.float64), scale)


def _pass(state: DataFrame, c: Round, width: int, scale: int) -> DataFrame:
    k = len(c.at)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 4096):
                batch = whole.slice(at, 4096)
                n = batch.num_rows
                x = _ints(batch.column("v"), width, scale)
                lower = np.zeros((n, k), np.float32) if c.first else _flat(batch.column("lower"), k, np.float32)
                own, upper, lower, computed = assign(x, batch.column("own").to_numpy(), batch.column("upper").to_numpy(), lower, c)
                columns = [batch.column("vec_id"), batch.column("v"), pa.array(own, pa.int32()), pa.array(upper, pa.float32()), _lists(lower, pa.float32()), pa.array(computed, pa.int32())]
                yield pa.RecordBatch.from_arrays(columns, ["vec_id", "v", "own", "upper", "lower", "computed"])

    kind = state.schema["vec_id"].dataType.simpleString()
    return state.mapInArrow(work, f"vec_id {kind}, v array<double>, own int, upper float, lower array<float>, computed int")


def _limbs(x: int) -> list[int]:
    out = []
    while x not in (0, -1) or not out:
        out.append(x & ((1 << LIMB) - 1))
        x >>= LIMB
    return [*out[:-1], out[-1] + (x << LIMB)]


def _sums(state: DataFrame, k: int, width: int, scale: int) -> dict[int, tuple[int, list[int]]]:
    """By centroid the number of its vectors and their exact sums by component; tasks add up first."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, sums = np.zeros(k, np.int64), [[0] * width for _ in range(k)]
        for batch in batches:
            own = batch.column("own").to_numpy()
            x = _ints(batch.column("v"), width, scale)
            for j in np.unique(own).tolist():
                mine = x[own == j]
                counts[j] += len(mine)
                part = mine.sum(0) if _wide(mine) else mine.astype(np.int64).sum(0)
                sums[j] = [a + int(b) for a, b in zip(sums[j], part.tolist(), strict=True)]
        rows = [(j, -1, 0, int(counts[j])) for j in range(k) if counts[j]]
        rows += [(j, i, level, limb) for j in range(k) if counts[j] for i, total in enumerate(sums[j]) for level, limb in enumerate(_limbs(total))]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int32(), pa.int32(), pa.int32(), pa.int64()))], ["own", "i", "level", "part"])

    parts = state.select("own", "v").mapInArrow(work, "own int, i int, level int, part bigint")
    total = parts.groupBy("own", "i", "level").agg(F.sum(F.col("part").cast("decimal(38,0)")).alias("part"))
    out: dict[int, tuple[int, list[int]]] = {}
    for r in total.collect():  # k centroids of a fixed width
        n, sums = out.get(r.own, (0, [0] * width))
        if r.i < 0:
            n = int(r.part)
        else:
            sums[r.i] += int(r.part) << (LIMB * r.level)
        out[r.own] = n, sums
    return out


def _kept(vectors: DataFrame, width: int) -> DataFrame:
    v = F.col("embedding")
    sound = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) != float("inf")))
    return vectors.filter(F.coalesce((F.size(v) == width) & sound, F.lit(False))).select("vec_id", v.cast("array<double>").alias("v"))


def kmeans(vectors: DataFrame, k: int = 40, rounds: int = 5, width: int = 64, scale: int = 256, seed: str = "2:") -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256, computed (how many distances the last pass computed for the row)."""
    spark = vectors.sparkSession
    tidy(spark)
    scratch = Scratch(spark, "kmeans")
    kept = _kept(vectors, width)
    start = F.sha2(F.concat(F.lit(seed), F.col("vec_id").cast("string")), 256)
    first = kept.filter("vec_id IS NOT NULL").orderBy(start, "vec_id", "v").limit(k).select("v").collect()
    centroids = [[int(v) for v in _as_ints(np.array([r.v], np.float64), scale)[0].tolist()] for r in first]
    k = len(centroids)
    none = F.lit(None).cast("double")
    state = kept.select("vec_id", "v", F.lit(0).alias("own"), F.lit(0.0).cast("float").alias("upper"), F.array().cast("array<float>").alias("lower"))
    if not k:
        return kept.filter("false").select("vec_id", F.lit(0).alias("cluster"), *(F.lit(0).cast("long").alias(c) for c in ("distance", "cluster_inertia", "inertia")), F.lit("").alias("centroid_sha256"), F.lit(0).alias("computed"))
    before = None
    for turn in range(rounds + 1):
        state = scratch.put(f"pass-{turn}", _pass(state, Round(centroids, before), width, scale))
        if turn:
            scratch.drop(f"pass-{turn - 1}")
        if turn < rounds:
            before = centroids
            sums = _sums(state, k, width, scale)
            centroids = [[s // sums[j][0] for s in sums[j][1]] if j in sums else before[j] for j in range(k)]
    return _measured(state, centroids, width, scale, scratch)


def _measured(state: DataFrame, centroids: list[list[int]], width: int, scale: int, scratch: Scratch) -> DataFrame:
    at = _matrix(centroids)
    kind = state.schema["vec_id"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column("own").to_numpy()
            exact = _squared(_ints(batch.column("v"), width, scale), at[own]).tolist()
            distance = pa.array([int(d) if d <= LONG else None for d in exact], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("own"), distance, batch.column("computed")], ["vec_id", "cluster", "distance", "computed"])

    found = scratch.put("found", state.select("vec_id", "v", "own", "computed").mapInArrow(work, f"vec_id {kind}, cluster int, distance bigint, computed int"))
    whole = F.sum(F.col("distance").cast("decimal(38,0)"))
    totals = found.groupBy("cluster").agg(F.when(F.count("distance") == F.count("*"), whole).alias("inertia")).collect()  # k rows
    by = {r.cluster: r.inertia for r in totals}
    every = sum(map(int, by.values())) if None not in by.values() else None
    fits = lambda x: int(x) if x is not None and x <= LONG else None
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    rows = [(j, fits(by[j]), fits(every), digests[j]) for j in sorted(by)]
    table = found.sparkSession.createDataFrame(rows, "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    return found.join(F.broadcast(table), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256", "computed")


def _oracle(k: int = 40, rounds: int = 5, width: int = 64, scale: int = 256) -> str:
    """The same in DuckDB's SQL: every distance, no bounds."""
    ctes = [
        f"kept AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings"
        f" WHERE len(embedding) = {width} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {width})",
        f"c0 AS MATERIALIZED (SELECT CAST(row_number() OVER (ORDER BY h, vec_id, v) - 1 AS INTEGER) AS cluster, v AS c FROM (SELECT sha256('2:' || CAST(vec_id AS VARCHAR)) AS h, * FROM kept WHERE vec_id IS NOT NULL) ORDER BY h, vec_id, v LIMIT {k})",
    ]
    for i in range(rounds + 1):
        ctes.append(
            f"a{i} AS MATERIALIZED (SELECT r, min(struct_pack(d := d, cluster := cluster)) AS m FROM"
            f" (SELECT r, cluster, CAST(list_sum(list_transform(range(1, {width + 1}), lambda i: (v[i] - c[i]) * (v[i] - c[i]))) AS BIGINT) AS d FROM kept, c{i}) GROUP BY r)"
        )
        if i < rounds:
            ctes.append(
                f"s{i} AS MATERIALIZED (SELECT cluster, i, CAST(sum(x) AS BIGINT) AS s, count(*) AS n FROM"
                f" (SELECT m.cluster AS cluster, unnest(range(1, {width + 1})) AS i, unnest(v) AS x FROM kept JOIN a{i} USING (r)) GROUP BY ALL)"
            )
            ctes.append(
                f"c{i + 1} AS MATERIALIZED (SELECT cluster, coalesce(new, c) AS c FROM c{i} LEFT JOIN"
                f" (SELECT cluster, list((s - ((s % n) + n) % n) // n ORDER BY i) AS new FROM s{i} GROUP BY cluster) USING (cluster))"
            )
    return (
        f"WITH {', '.join(ctes)}, f AS (SELECT vec_id, m.cluster AS cluster, m.d AS distance FROM kept JOIN a{rounds} USING (r)) "
        "SELECT vec_id, cluster, distance, CAST(sum(distance) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia, CAST(sum(distance) OVER () AS BIGINT) AS inertia,"
        f" sha256(array_to_string(c, ',')) AS centroid_sha256 FROM f JOIN c{rounds} USING (cluster)"
    )


ORACLE = _oracle()
