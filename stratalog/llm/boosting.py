"""Gradient-boosted regression trees on small tables, for logistic loss."""

from __future__ import annotations

import numpy as np


class Boosted:
    """Depth-limited trees over quantile bins, fitted by Newton steps; then a Platt calibration on held-out rows."""

    def __init__(self, rounds: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 16, l2: float = 1.0):
        self.rounds, self.depth, self.rate, self.bins, self.l2 = rounds, depth, rate, bins, l2
        self.trees: list[list[tuple[np.ndarray, np.ndarray]]] = []
        self.values: list[np.ndarray] = []
        self.bias, self.scale, self.shift = 0.0, 1.0, 0.0

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        held = np.arange(len(y)) % 5 == 0
        self._fit(x[~held], y[~held])
        raw, t = self.raw(x[held]), y[held].astype(float)
        a, b = 1.0, 0.0
        for _ in range(200):
            p = 1 / (1 + np.exp(-(a * raw + b)))
            a -= 0.1 * (((p - t) * raw).mean() + 0.001 * (a - 1))
            b -= 0.1 * (p - t).mean()
        self.scale, self.shift = a, b
        return self

    def _fit(self, x: np.ndarray, y: np.ndarray) -> None:
        edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) for j in range(x.shape[1])]
        binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], 1)
        self.bias = float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
        raw = np.full(len(y), self.bias)
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-raw))
            g, h = y - p, p * (1 - p)
            node, levels = np.zeros(len(y), np.int64), []
            for level in range(self.depth):
                count = 1 << level
                best, feature, cut = np.full(count, 1e-9), np.zeros(count, np.int64), np.full(count, np.inf)
                gs, hs = np.bincount(node, g, count), np.bincount(node, h, count)
                for j, e in enumerate(edges):
                    width = len(e) + 1
                    key = node * width + binned[:, j]
                    gl = np.bincount(key, g, count * width).reshape(count, width).cumsum(1)[:, :-1]
                    hl = np.bincount(key, h, count * width).reshape(count, width).cumsum(1)[:, :-1]
                    gr, hr = gs[:, None] - gl, hs[:, None] - hl
                    gain = gl**2 / (hl + self.l2) + gr**2 / (hr + self.l2) - (gs**2 / (hs + self.l2))[:, None]
                    if gain.shape[1]:
                        k = gain.argmax(1)
                        top = gain[np.arange(count), k]
                        better = top > best
                        best[better], feature[better], cut[better] = top[better], j, e[k[better]]
                levels.append((feature, cut))
                node = 2 * node + (x[np.arange(len(y)), feature[node]] > cut[node])
            leaves = 1 << self.depth
            value = self.rate * np.bincount(node, g, leaves) / (np.bincount(node, h, leaves) + self.l2)
            self.trees.append(levels)
            self.values.append(value)
            raw += value[node]

    def raw(self, x: np.ndarray) -> np.ndarray:
        out, rows = np.full(len(x), self.bias), np.arange(len(x))
        for levels, value in zip(self.trees, self.values, strict=True):
            node = np.zeros(len(x), np.int64)
            for feature, cut in levels:
                node = 2 * node + (x[rows, feature[node]] > cut[node])
            out += value[node]
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.scale * self.raw(x) + self.shift)))
