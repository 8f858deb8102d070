"""What the classifiers share: the fold rule, the labelled sample, calibration, measures."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Labelled rows that a classifier is fitted on at most, those whose ids hash lowest, and bytes of their texts at most: the driver holds the sample.
#: The only bounds here; scoring, thresholds and measures have none.
SAMPLE, SAMPLE_BYTES = 6000, 64_000_000


def held_out(doc_id: str = "doc_id") -> Column:
    """A fifth of the ids, which no label is learnt from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(False))


def known(labels: DataFrame, label: str) -> DataFrame:
    """doc_id, y of the labelled ids outside the held-out fold; null labels and ids are left out, of several labels of an id the greatest counts."""
    rows = labels.select("doc_id", F.col(label).cast("int").alias("y")).filter(F.col("y").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
    return rows.groupBy("doc_id").agg(F.max("y").alias("y"))


def _fitting(sizes: list[int], most: int) -> list[bool]:
    """Which of them are taken in turn, each that still fits."""
    taken, left = [], most
    for n in sizes:
        taken.append(n <= left)
        left -= n if n <= left else 0
    return taken


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, most: int = SAMPLE, most_bytes: int = SAMPLE_BYTES) -> pd.DataFrame:
    """doc_id, text, y, hash (of the text) of at most `most` labelled ids outside the held-out fold, in order of their hash; a text that would bring them over
    `most_bytes` together is passed over, and the next one is tried. One row an id, equal texts once. If labels have texts and none fits, that is an error."""
    order = F.xxhash64("doc_id"), F.col("doc_id")
    # bounded by the limit, so the sample's ids can be broadcast whatever the size of the tables
    chosen = known(labels, label).orderBy(*order).limit(most)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")
    # of an id's texts the one that hashes lowest
    one = rows.groupBy("doc_id", "y").agg(F.min(F.struct(F.xxhash64("text").alias("hash"), F.octet_length("text").alias("size"))).alias("x")).select("doc_id", "y", "x.*")
    sizes = one.orderBy(*order).toPandas()
    if not len(sizes):
        return pd.DataFrame({"doc_id": sizes.doc_id, "text": pd.Series(dtype=object), "y": sizes.y, "hash": sizes.hash})
    sizes = sizes[_fitting(sizes["size"].tolist(), most_bytes)]
    if not len(sizes):
        raise ValueError(f"every labelled text has more than {most_bytes} bytes")
    mine = docs.sparkSession.createDataFrame(sizes[["doc_id", "y", "hash"]], f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, y int, hash bigint")
    found = rows.drop("y").withColumn("hash", F.xxhash64("text")).join(F.broadcast(mine), ["doc_id", "hash"]).dropDuplicates(["doc_id", "hash"]).select("doc_id", "text", "y", "hash")
    # a text that many rows copy would pass for evidence on each of its words
    return found.toPandas().sort_values("doc_id").drop_duplicates("text", ignore_index=True)


def platt(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """a, b of the probability 1 / (1 + exp(-(a * margin + b))), by Newton steps on smoothed targets."""
    up, down = y.sum(), len(y) - y.sum()
    if not len(y) or not up or not down:
        return 1.0, 0.0
    t = np.where(y == 1, (up + 1) / (up + 2), 1 / (down + 2))
    x = np.stack((margin, np.ones_like(margin)), 1)
    w = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p) + 1e-9)[:, None]) + 1e-6 * np.eye(2), x.T @ (p - t) + 1e-6 * w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return (float(w[0]), float(w[1])) if w[0] > 0 else (1.0, 0.0)


def best_threshold(score: np.ndarray, y: np.ndarray) -> float:
    """Midway between the scores where F1 is greatest."""
    order = np.argsort(-score, kind="stable")
    s, hit = score[order], np.cumsum(y[order])
    last = np.flatnonzero(np.append(s[1:] != s[:-1], True))
    f1 = 2 * hit[last] / (last + 1 + y.sum())
    k = int(f1.argmax())
    below = s[last[k] + 1] if last[k] + 1 < len(s) else s[-1]
    return float((s[last[k]] + below) / 2)


def histogram_threshold(up: np.ndarray, down: np.ndarray) -> float:
    """Where F1 is greatest, of counts of either class in equal bins of the score from 0 to 1; in the middle of the longest run of equally good cuts."""
    hit, miss = np.cumsum(up[::-1])[::-1], np.cumsum(down[::-1])[::-1]
    f1 = 2 * hit / np.maximum(hit + miss + up.sum(), 1e-9)
    best = np.flatnonzero(f1 >= f1.max() - 1e-12)
    runs = np.split(best, np.flatnonzero(np.diff(best) > 1) + 1)
    longest = max(runs, key=len)
    return float((longest[0] + longest[-1]) / 2 / len(up))


def auc(score: np.ndarray, y: np.ndarray) -> float:
    rank = pd.Series(score).rank().to_numpy()
    up = y.sum()
    return float((rank[y == 1].sum() - up * (up + 1) / 2) / (up * (len(y) - up)))
