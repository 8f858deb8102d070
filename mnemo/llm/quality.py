"""Operator 5, quality by naive Bayes support vectors.

Indicators of n-grams are scaled by the log-count ratios of the two classes, then a linear hinge-loss model is fitted by dual
coordinate descent (Hsieh et al. 2008) and interpolated with the mean weight (Wang and Manning 2012). Two sequences supply n-grams:
the words (lower case, one and two in a row), and their shapes (case, length class, the punctuation around, whether the word
repeats one of the two before; one to three in a row), which say of words never met whether they are junk. n-grams are hashed to
2**BITS indicators. Margins of rows set aside are scaled to probabilities.

Fitting uses a bounded sample of labelled rows (SAMPLE), for the class counts too; scoring is one pass over whole texts
without a shuffle. Defined cases: null and empty texts have no n-grams and score by the constant alone; null ids are scored and not
held out; repeated rows each get a row; equal scores share their verdict; long texts are whole, one in a chunk; an empty table gives an
empty result; without labels of both classes the score is the class that there is; further columns are left aside."""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from mnemo.llm.common import chunks, text_of, tidy
from mnemo.llm.training import held_out, labelled_sample, platt

BITS = 18
SIZE = 1 << BITS
#: Labelled rows that the model is fitted on at most.
SAMPLE = 3000
#: Share of the fitted weights, the rest being their mean magnitude.
BETA = 0.25
COST, ROUNDS = 1.0, 30
PARTS = re.compile(r"^(\W*)(.*?)(\W*)$", re.S)
MEMO: dict[str, tuple[int, int]] = {}


def _token(raw: str) -> tuple[int, int]:
    """Hash of the lower-case word, and of its shape."""
    lead, core, tail = PARTS.match(raw).groups()
    case = "d" if core.isdigit() else "U" if core.isupper() and len(core) > 1 else "T" if core[:1].isupper() else "l" if core.islower() else "m" if core else "-"
    shape = f"{lead[:3]}{case}{min(len(core), 30) // 6}{tail[:3]}"
    return zlib.crc32(core.lower().encode()), zlib.crc32(shape.encode())


def indicators(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of text and indicator, each once, in order."""
    sizes, flat = [], []
    for t in texts:
        words = t.split()
        sizes.append(len(words))
        for w in words:
            x = MEMO.get(w)
            if x is None:
                if len(MEMO) > 300_000:
                    MEMO.clear()
                x = MEMO[w] = _token(w)
            flat.append(x)
    if not flat:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    doc = np.repeat(np.arange(len(texts)), sizes)
    word, shape = np.array(flat, np.uint64).T
    same = [np.concatenate((np.zeros(k, bool), (word[k:] == word[:-k]) & (doc[k:] == doc[:-k]))) if len(word) > k else np.zeros(len(word), bool) for k in (1, 2)]
    shape = shape * np.uint64(4) + same[0] + 2 * same[1].astype(np.uint64)
    texts_, found = [], []
    for tag, gram, most in ((1, word, 2), (2, shape, 3)):
        h = gram
        for n in range(1, most + 1):
            if n > 1:
                h = h[:-1] * np.uint64(0x9E3779B97F4A7C15) + gram[n - 1 :]
            ok = doc[n - 1 :] == doc[: len(doc) - n + 1]
            mixed = (h + np.uint64(tag * 8 + n)) * np.uint64(0xD6E8FEB86659FD93)
            found.append((mixed >> np.uint64(64 - BITS)).astype(np.int64)[ok])
            texts_.append(doc[n - 1 :][ok])
    return np.concatenate(texts_), np.concatenate(found)


def _once(doc: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    both = np.unique(doc * SIZE + at)
    return both // SIZE, both % SIZE


@dataclass
class Linear:
    weights: np.ndarray  # one per indicator, log-count ratio multiplied in
    base: float
    scale: tuple[float, float] = (1.0, 0.0)

    def margins(self, texts: list[str]) -> np.ndarray:
        doc, at = indicators(texts)
        met = self.weights[at] != 0
        doc, at = _once(doc[met], at[met])
        return np.bincount(doc, self.weights[at], len(texts)) + self.base

    def scores(self, texts: list[str]) -> np.ndarray:
        a, b = self.scale
        return 1 / (1 + np.exp(-np.clip(a * self.margins(texts) + b, -30, 30)))


def descend(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, size: int, cost: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Weights (the constant last) of least |w|**2 / 2 + sum cost * hinge, by coordinate steps on the dual. rows: indices, values."""
    w, alpha = np.zeros(size + 1), np.zeros(len(y))
    norm = np.array([v @ v + 1 for _, v in rows])
    for _ in range(ROUNDS):
        most = 0.0
        for i in rng.permutation(len(y)):
            at, v = rows[i]
            g = y[i] * (w[at] @ v + w[-1]) - 1
            new = min(max(alpha[i] - g / norm[i], 0.0), cost[i])
            if d := (new - alpha[i]) * y[i]:
                w[at] += d * v
                w[-1] += d
                alpha[i] = new
                most = max(most, abs(d))
        if most < 1e-3:
            break
    return w


def train(texts: list[str], y: np.ndarray, seed: int = 5) -> Linear:
    y, rng = np.asarray(y, int), np.random.default_rng(seed)
    if not len(y) or y.min() == y.max():
        return Linear(np.zeros(SIZE), 30.0 if len(y) and y[0] else -30.0)
    aside = rng.permutation(len(y)) % 5 == 0
    own = np.flatnonzero(~aside) if 0 < y[~aside].mean() < 1 and 0 < y[aside].mean() < 1 else np.arange(len(y))
    docs, ats = [], []
    for i in range(0, len(own), 200):
        d, a = _once(*indicators([texts[k] for k in own[i : i + 200]]))
        docs.append((d + i).astype(np.int32))
        ats.append(a.astype(np.int32))
    doc, at = np.concatenate(docs), np.concatenate(ats)
    up = np.bincount(at, y[own][doc], SIZE)
    all_ = np.bincount(at, minlength=SIZE)
    ratio = np.log((up + 1) / (up.sum() + SIZE)) - np.log((all_ - up + 1) / ((all_ - up).sum() + SIZE))
    ratio[all_ < 2] = 0
    live = ratio[at] != 0
    doc, at = doc[live], at[live]
    cuts = np.searchsorted(doc, np.arange(len(own) + 1))
    # texts differ in length by thousands of times: each row is scaled to unit length for the descent
    rows = []
    for s, e in zip(cuts[:-1], cuts[1:], strict=True):
        v = ratio[at[s:e]]
        rows.append((at[s:e], v / max(np.sqrt(v @ v), 1e-9) * 4))
    sign = 2 * y[own] - 1
    cost = np.where(sign > 0, 1.0, (sign > 0).sum() / (sign < 0).sum()) ** 0.5 * COST
    w = descend(rows, sign, SIZE, cost, rng)
    return _Unit(interpolated(w[:-1], ratio), ratio, float(BETA * w[-1])).calibrated([texts[i] for i in (np.flatnonzero(aside) if len(own) < len(y) else own)], y[aside] if len(own) < len(y) else y)


def interpolated(w: np.ndarray, ratio: np.ndarray) -> np.ndarray:
    """Between the mean magnitude of the weights of live indicators (those with a ratio) and the weights themselves. Indicators are scaled by
    their ratio, so the mean lets each vote as its ratio does."""
    live = ratio != 0
    mean = np.abs(w[live]).mean() if live.any() else 0.0
    return np.where(live, (1 - BETA) * mean + BETA * w, 0.0)


class _Unit(Linear):
    """A linear model over rows of ratio-scaled indicators of unit length."""

    def __init__(self, weights: np.ndarray, ratio: np.ndarray, base: float):
        super().__init__(weights, base)
        self.ratio = ratio

    def margins(self, texts: list[str]) -> np.ndarray:
        doc, at = indicators(texts)
        met = self.ratio[at] != 0
        doc, at = _once(doc[met], at[met])
        r = self.ratio[at]
        length = np.sqrt(np.bincount(doc, r * r, len(texts)))
        return 4 * np.bincount(doc, r * self.weights[at], len(texts)) / np.maximum(length, 1e-9) + self.base

    def calibrated(self, texts: list[str], y: np.ndarray) -> _Unit:
        margin = np.concatenate([self.margins(texts[i : i + 200]) for i in range(0, len(texts), 200)])
        self.scale = platt(margin, y)
        return self


def fit(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> Linear:
    rows = labelled_sample(docs, labels, "quality", most)
    return train(rows.text.tolist(), rows.y.to_numpy())


def score(docs: DataFrame, model: Linear, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    tidy(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)  # 2**BITS weights and ratios

    def work(batches):
        tool = held.value
        for part in chunks(batches):
            s = tool.scores(part.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), pa.array(s, pa.float64()), pa.array((s >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return docs.select("doc_id", held_out().alias("held_out"), text_of().alias("text")).mapInArrow(work, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, held_out boolean, score double, predicted int")
