"""A small CART classifier in numpy: gini splits on numeric features, fitted once on a bounded labelled table."""

from __future__ import annotations

import numpy as np


class Tree:
    """Fitted by ``fit``; plain arrays, so it is cheap to ship to workers."""

    def __init__(self, depth: int = 12, least: int = 3) -> None:
        self.depth, self.least = depth, least
        self.feature: list[int] = []
        self.cut: list[float] = []
        self.left: list[int] = []
        self.right: list[int] = []
        self.value: list[float] = []

    def fit(self, x: np.ndarray, y: np.ndarray) -> Tree:
        self._grow(np.asarray(x, float), np.asarray(y, float), 0)
        self.arrays = tuple(np.array(a) for a in (self.feature, self.cut, self.left, self.right, self.value))
        return self

    def _grow(self, x: np.ndarray, y: np.ndarray, depth: int) -> int:
        node = len(self.value)
        for a, v in ((self.feature, -1), (self.cut, 0.0), (self.left, -1), (self.right, -1), (self.value, float(y.mean()))):
            a.append(v)
        if depth < self.depth and len(y) >= 2 * self.least and 0 < y.mean() < 1:
            best = max((self._split(x[:, j], y) + (j,) for j in range(x.shape[1])), key=lambda s: s[0])
            if best[0] > 1e-9:
                _, cut, j = best
                low = x[:, j] <= cut
                self.feature[node], self.cut[node] = j, cut
                self.left[node] = self._grow(x[low], y[low], depth + 1)
                self.right[node] = self._grow(x[~low], y[~low], depth + 1)
        return node

    def _split(self, v: np.ndarray, y: np.ndarray) -> tuple[float, float]:
        order = np.argsort(v, kind="stable")
        v, y = v[order], y[order]
        n = len(y)
        ones = np.cumsum(y)[:-1]
        size = np.arange(1, n)
        gain = ones**2 / size + (size - ones) ** 2 / size + (y.sum() - ones) ** 2 / (n - size) + ((n - size) - (y.sum() - ones)) ** 2 / (n - size)
        base = y.sum() ** 2 / n + (n - y.sum()) ** 2 / n
        ok = (v[1:] > v[:-1]) & (size >= self.least) & (n - size >= self.least)
        if not ok.any():
            return 0.0, 0.0
        i = int(np.argmax(np.where(ok, gain, -np.inf)))
        return float(gain[i] - base), float((v[i] + v[i + 1]) / 2)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Share of positive training rows in each row's leaf."""
        feature, cut, left, right, value = self.arrays
        at = np.zeros(len(x), np.int64)
        while (inner := feature[at] >= 0).any():
            i = np.flatnonzero(inner)
            go = x[i, feature[at[i]]] <= cut[at[i]]
            at[i] = np.where(go, left[at[i]], right[at[i]])
        return value[at]
