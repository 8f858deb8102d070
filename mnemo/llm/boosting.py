"""Gradient-boosted regression trees for the logistic loss, in numpy: small depth, second-order leaf values."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


@dataclass
class Tree:
    feature: list[int] = field(default_factory=list)
    cut: list[float] = field(default_factory=list)
    left: list[int] = field(default_factory=list)
    right: list[int] = field(default_factory=list)
    value: list[float] = field(default_factory=list)

    def grow(self, x: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int, ridge: float, least: int) -> int:
        node = len(self.value)
        for column, start in ((self.feature, -1), (self.cut, 0.0), (self.left, -1), (self.right, -1), (self.value, float(-g.sum() / (h.sum() + ridge)))):
            column.append(start)
        best = (1e-6, -1, 0.0)
        if depth and len(g) >= 2 * least:
            whole = g.sum() ** 2 / (h.sum() + ridge)
            for j in range(x.shape[1]):
                order = np.argsort(x[:, j], kind="stable")
                v, a, b = x[order, j], np.cumsum(g[order]), np.cumsum(h[order])
                at = np.flatnonzero(v[1:] > v[:-1])
                at = at[(at + 1 >= least) & (len(v) - at - 1 >= least)]
                if len(at):
                    gain = a[at] ** 2 / (b[at] + ridge) + (a[-1] - a[at]) ** 2 / (b[-1] - b[at] + ridge) - whole
                    if gain.max() > best[0]:
                        k = at[gain.argmax()]
                        best = (float(gain.max()), j, float((v[k] + v[k + 1]) / 2))
        if best[1] >= 0:
            go = x[:, best[1]] <= best[2]
            self.feature[node], self.cut[node] = best[1:]
            self.left[node] = self.grow(x[go], g[go], h[go], depth - 1, ridge, least)
            self.right[node] = self.grow(x[~go], g[~go], h[~go], depth - 1, ridge, least)
        return node

    def predict(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), int)
        feature, cut, left, right = (np.array(c) for c in (self.feature, self.cut, self.left, self.right))
        for _ in range(len(self.value)):
            inner = np.flatnonzero(feature[at] >= 0)
            if not len(inner):
                break
            k = at[inner]
            at[inner] = np.where(x[inner, feature[k]] <= cut[k], left[k], right[k])
        return np.array(self.value)[at]


@dataclass
class Boosted:
    trees: list[Tree]
    base: float
    rate: float

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, rounds: int = 30, depth: int = 3, rate: float = 0.3, ridge: float = 1.0, least: int = 8) -> Boosted:
        mean = min(max(float(y.mean()), 1e-3), 1 - 1e-3)
        model = cls([], float(np.log(mean / (1 - mean))), rate)
        margin = np.full(len(y), model.base)
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-margin))
            tree = Tree()
            tree.grow(x, p - y, p * (1 - p) + 1e-9, depth, ridge, least)
            model.trees.append(tree)
            margin += rate * tree.predict(x)
        return model

    def margins(self, x: np.ndarray) -> np.ndarray:
        return self.base + self.rate * sum((t.predict(x) for t in self.trees), np.zeros(len(x)))

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margins(x), -30, 30)))
