"""Operator 4, toxicity by a convolutional text classifier written and trained in numpy.

Words are hashed, each whole and by its first letters. A word that several training texts have uses its own bucket, a rarer one
that of its first letters; buckets not met in training have the zero vector. Filters of several widths slide
over the embedded words, each keeps its greatest response in the whole text (max pooling), and a linear layer over these gives
the margin. One embedding dimension starts at the word's smoothed class log-ratio, so that the first greatest responses are
at telling words. Training: Adagrad on the weighted logistic loss; a fifth of the sample is set aside to scale margins to probabilities.

Fitting uses a bounded sample of labelled rows (training.SAMPLE). Rejection thresholds by language are calibrated on all labelled rows outside the
held-out fold that the weights were not fitted to: they are scored, counted by language, label and bin of the score, and each language takes
the cut of greatest F1 on its own counts, to which the counts of all languages are added with the weight of PRIOR rows of either class (so a language
with few labels stays near the common cut). Language is no input of the score. Scoring is one pass over whole texts without a shuffle.

Defined cases: null and empty texts score as a text without telling words; a null language is one of its own; a language without labels takes the
common threshold; null ids are scored and not held out; repeated rows each get a row; equal scores share their verdict; long texts are whole, one in a
chunk; an empty table gives an empty result; without labels of both classes all scores are 0 and nothing is rejected; further columns are left aside."""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemo.llm.common import Scratch, chunks, text_of, tidy
from mnemo.llm.training import SAMPLE, best_threshold, held_out, histogram_threshold, known, labelled_sample, platt

WORD = re.compile(r"\w+")
WIDTHS = (1, 2, 3)
FILTERS, DIM, EPOCHS, BATCH, RATE = 8, 8, 6, 32, 0.1
#: Texts that must have a word for a bucket of its own.
OFTEN = 4
#: Letters by which rare words are hashed.
STEM = 4
#: Rows of either class, set aside, from which on their best cut is where the score is one half.
LEAST = 20
#: What the counts of all languages weigh in those of one, in rows of either class; bins of the score.
PRIOR, BINS = 10, 1000
STEMS, WORDS = (1 << 31) - 1, 1 << 31
MEMO: dict[str, int] = {}


def hashed(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The texts' words on end, 31 bits of hash of the word above 31 bits of its first letters; the number of words of each text."""
    flat, sizes = [], []
    for t in texts:
        words = WORD.findall(t.lower())
        sizes.append(len(words))
        for w in words:
            h = MEMO.get(w)
            if h is None:
                if len(MEMO) > 200_000:
                    MEMO.clear()
                h = MEMO[w] = (zlib.crc32(w.encode()) >> 1) << 31 | zlib.crc32(w[:STEM].encode()) >> 1
            flat.append(h)
    return np.array(flat, np.int64), np.array(sizes, np.int64)


@dataclass
class Convolutional:
    buckets: np.ndarray  # sorted hashes that have an embedding
    embedding: np.ndarray  # one row each, then the zero row for all others and for padding
    filters: list[np.ndarray]  # per width: width x DIM x FILTERS
    bias: list[np.ndarray]
    out: np.ndarray
    base: float = 0.0
    scale: tuple[float, float] = (1.0, 0.0)
    thresholds: dict[str | None, float] = field(default_factory=dict)
    common: float = 0.5
    aside: np.ndarray = field(default_factory=lambda: np.zeros(0, bool))

    def rows(self, flat: np.ndarray) -> np.ndarray:
        """Rows of the embedding for hashed words."""
        if not len(self.buckets):
            return np.zeros(len(flat), np.int64)
        used, back = np.unique(flat, return_inverse=True)
        row = np.full(len(used), len(self.buckets))
        for key in (used & STEMS, (used >> 31) + WORDS):  # the word's own bucket comes second and overrules
            at = np.minimum(np.searchsorted(self.buckets, key), len(self.buckets) - 1)
            row = np.where(self.buckets[at] == key, at, row)
        return row[back]

    def padded(self, rows: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each text followed by padding as wide as the widest filter, so none spans two texts; where each text starts."""
        pad = max(WIDTHS)
        starts = np.concatenate(([0], np.cumsum(sizes + pad)))
        x = np.full(starts[-1] + pad, len(self.buckets))
        x[np.arange(len(rows)) + np.repeat(pad * np.arange(len(sizes)), sizes)] = rows
        return x, starts

    def respond(self, embedded: np.ndarray, k: int) -> np.ndarray:
        """Of the filters of the k-th width at each place of the embedded words."""
        n, z = len(embedded) - max(WIDTHS), self.bias[k]
        for i in range(WIDTHS[k]):
            z = z + embedded[i : n + i] @ self.filters[k][i]
        return z

    def margins(self, texts: list[str]) -> np.ndarray:
        flat, sizes = hashed(texts)
        if not len(texts):
            return np.zeros(0)
        x, starts = self.padded(self.rows(flat), sizes)
        embedded, pooled = self.embedding[x], []
        for k in range(len(WIDTHS)):
            pooled.append(np.maximum(np.maximum.reduceat(self.respond(embedded, k), starts[:-1], axis=0), 0))
        return np.concatenate(pooled, 1) @ self.out + self.base

    def scores(self, texts: list[str]) -> np.ndarray:
        a, b = self.scale
        return 1 / (1 + np.exp(-np.clip(a * self.margins(texts) + b, -30, 30)))

    def threshold(self, lang: str | None) -> float:
        return self.thresholds.get(lang, self.common)


def _start(flat: np.ndarray, sizes: np.ndarray, y: np.ndarray, rng: np.random.Generator) -> Convolutional:
    doc = np.repeat(np.arange(len(sizes)), sizes)
    used, back = np.unique(flat, return_inverse=True)
    often = np.bincount(np.unique(doc * len(used) + back) % len(used), minlength=len(used)) >= OFTEN
    buckets, at = np.unique(np.where(often, (used >> 31) + WORDS, used & STEMS)[back], return_inverse=True)
    seen = np.unique(doc * len(buckets) + at)
    up = np.bincount(seen % len(buckets), y[seen // len(buckets)], len(buckets)) + 0.5
    down = np.bincount(seen % len(buckets), 1 - y[seen // len(buckets)], len(buckets)) + 0.5
    embedding = rng.normal(0, 0.02, (len(buckets) + 1, DIM)).astype(np.float32)
    embedding[:-1, 0] = np.clip(np.log(up / (y.sum() + 1)) - np.log(down / (len(y) - y.sum() + 1)), -4, 4) / 4
    embedding[-1] = 0
    filters = [rng.normal(0, 0.2, (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS]
    for f in filters:
        f[0, 0] = np.abs(f[0, 0]) + 0.5
    return Convolutional(buckets, embedding, filters, [np.zeros(FILTERS, np.float32) for _ in WIDTHS], np.full(FILTERS * len(WIDTHS), 0.2, np.float32), -1.0)


def train(texts: list[str], y: np.ndarray, seed: int = 7) -> Convolutional:
    """Of texts with labels 0 and 1; aside says which of them the weights were not fitted to."""
    rng = np.random.default_rng(seed)
    y = np.asarray(y, float)
    if not len(y) or y.min() == y.max():
        return Convolutional(np.zeros(0, np.int64), np.zeros((1, DIM), np.float32), [np.zeros((w, DIM, FILTERS), np.float32) for w in WIDTHS], [np.zeros(FILTERS, np.float32) for _ in WIDTHS], np.zeros(FILTERS * len(WIDTHS), np.float32), -30.0)
    aside = rng.permutation(len(y)) % 5 == 0
    own = np.flatnonzero(~aside) if 0 < y[~aside].mean() < 1 and 0 < y[aside].mean() < 1 else np.arange(len(y))
    flat, sizes = (np.concatenate(x) for x in zip(*(hashed(texts[i : i + 200]) for i in range(0, len(texts), 200)), strict=True))
    ends = np.cumsum(sizes)
    mine = np.repeat(np.isin(np.arange(len(y)), own), sizes)
    net = _start(flat[mine], sizes[own], y[own], rng)
    rows = net.rows(flat)
    weight = np.where(y == 1, (len(own) - y[own].sum()) / y[own].sum(), 1.0) ** 0.5
    past = [np.full_like(p, 1e-4) for p in (net.embedding, *net.filters, *net.bias, net.out)]
    base_past = 1e-4

    def step(p, g, k, at=slice(None)):
        past[k][at] += g * g
        p[at] -= RATE * g / np.sqrt(past[k][at])

    for _ in range(EPOCHS):
        for part in np.array_split(rng.permutation(own), max(1, len(own) // BATCH)):
            x, starts = net.padded(np.concatenate([rows[ends[d] - sizes[d] : ends[d]] for d in part]), sizes[part])
            tops, places, embedded = [], [], net.embedding[x]
            for k in range(len(WIDTHS)):
                z = net.respond(embedded, k)
                place = np.stack([z[s:e].argmax(0) + s for s, e in zip(starts[:-1], starts[1:], strict=True)])
                tops.append(np.maximum(z[place, np.arange(FILTERS)], 0))
                places.append(place)
            pooled = np.concatenate(tops, 1)
            p = 1 / (1 + np.exp(-np.clip(pooled @ net.out + net.base, -30, 30)))
            d = (weight[part] * (p - y[part]) / len(part)).astype(np.float32)
            back = d[:, None] * net.out * (pooled > 0)
            step(net.out, d @ pooled + 1e-4 * net.out, -1)
            base_past += float(d.sum()) ** 2
            net.base -= RATE * float(d.sum()) / base_past**0.5
            met, moved = [], []
            for k, w in enumerate(WIDTHS):
                g = back[:, k * FILTERS : (k + 1) * FILTERS]
                for i in range(w):
                    vec = net.embedding[x[places[k] + i]]
                    met.append(x[places[k] + i].ravel())
                    moved.append((g[:, :, None] * net.filters[k][i].T[None]).reshape(-1, DIM))
                    step(net.filters[k], np.einsum("bf,bfd->df", g, vec) + 1e-4 * net.filters[k][i], 1 + k, i)
                step(net.bias[k], g.sum(0), 1 + len(WIDTHS) + k)
            met, moved = np.concatenate(met), np.concatenate(moved)
            at, inverse = np.unique(met, return_inverse=True)
            grad = np.zeros((len(at), DIM), np.float32)
            np.add.at(grad, inverse, moved)
            real = at < len(net.buckets)
            step(net.embedding, grad[real], 0, at[real])
    test = np.flatnonzero(aside) if len(own) < len(y) else own
    margin = np.concatenate([net.margins([texts[i] for i in part]) for part in np.array_split(test, len(test) // 200 + 1)])
    a, b = platt(margin, y[test])
    if min(y[test].sum(), len(test) - y[test].sum()) >= LEAST:
        b = -a * best_threshold(margin, y[test])  # one half is where the rows set aside are told apart best
    net.scale = a, b
    net.aside = aside if len(own) < len(y) else np.zeros(len(y), bool)
    return net


def thresholds(counts: dict[str | None, np.ndarray]) -> tuple[dict[str | None, float], float]:
    """By language, and of all together, from counts (2 x BINS: labels 1 and 0 by bin of the score)."""
    total = sum(counts.values(), np.zeros((2, BINS)))
    if not total.sum(1).all():
        return {}, 0.5
    shared = PRIOR * total / total.sum(1, keepdims=True)
    return {lang: histogram_threshold(*(own + shared)) for lang, own in counts.items()}, histogram_threshold(*total)


def _langs(docs: DataFrame) -> DataFrame:
    return docs if "lang" in docs.columns else docs.withColumn("lang", F.lit(None).cast("string"))


def scored(docs: DataFrame, net: Convolutional) -> DataFrame:
    """doc_id, held_out, lang, body (a hash of the text), score for every row."""
    tidy(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(net)  # bounded by the sample's vocabulary

    def work(batches):
        for part in chunks(batches):
            s = held.value.scores(part.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("doc_id", "held_out", "lang", "body")), pa.array(s, pa.float64())], ["doc_id", "held_out", "lang", "body", "score"])

    rows = _langs(docs).select("doc_id", held_out().alias("held_out"), F.col("lang").cast("string").alias("lang"), F.xxhash64(text_of()).alias("body"), text_of().alias("text"))
    return rows.mapInArrow(work, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, held_out boolean, lang string, body bigint, score double")


def calibrated(net: Convolutional, fitted: list, scores: DataFrame, labels: DataFrame) -> Convolutional:
    """With thresholds from the scores (written) of all labelled rows outside the held-out fold, but for copies of the texts (by hash) that the weights were fitted to."""
    used = scores.sparkSession.createDataFrame([(int(h),) for h in fitted], "body bigint")  # bounded as the sample is
    rows = scores.filter("doc_id IS NOT NULL AND NOT held_out").join(known(labels, "toxic"), "doc_id").join(F.broadcast(used), "body", "left_anti")
    bins = rows.groupBy("lang", (1 - F.col("y")).alias("row"), F.least(F.floor(F.col("score") * BINS), F.lit(BINS - 1)).cast("int").alias("bin")).count()
    counts: dict[str | None, np.ndarray] = {}
    for r in bins.filter("row IN (0, 1)").collect():  # a row for each bin and language
        counts.setdefault(r["lang"], np.zeros((2, BINS)))[r["row"], r["bin"]] = r["count"]
    net.thresholds, net.common = thresholds(counts)
    return net


def fit(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> tuple[Convolutional, DataFrame]:
    """The calibrated classifier, and scored(docs) as a written table."""
    rows = labelled_sample(docs, labels, "toxic", most)
    net = train(rows.text.tolist(), rows.y.to_numpy())
    scores = Scratch(docs.sparkSession, "toxicity").put("scores", scored(docs, net))
    return calibrated(net, rows.hash[~net.aside[: len(rows)]].tolist() if len(net.aside) else rows.hash.tolist(), scores, labels), scores


def verdicts(scores: DataFrame, net: Convolutional) -> DataFrame:
    """doc_id, held_out, score, predicted (score of 0.5 or more), rejected (the calibrated threshold of the row's language)."""
    bar = F.coalesce(*[F.when(F.col("lang").eqNullSafe(F.lit(lang)), F.lit(x)) for lang, x in net.thresholds.items()], F.lit(net.common))
    return scores.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), (F.col("score") >= bar).alias("rejected"))


def accepted(docs: DataFrame, net: Convolutional) -> DataFrame:
    """The rows of docs that the classifier doesn't reject, whole and unchanged."""
    tidy(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(net)
    lang = "lang" in docs.columns

    def work(batches):
        model = held.value
        for part in chunks(batches):
            s = model.scores([t or "" for t in part.column("text").to_pylist()])
            langs = part.column("lang").to_pylist() if lang else [None] * part.num_rows
            yield part.filter(pa.array(s < np.array([model.threshold(x) for x in langs])))

    return docs.mapInArrow(work, docs.schema)
