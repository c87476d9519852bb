"""Linear-chain conditional random fields with two labels over dense features, in numpy.

Sequences are laid out one after another: ``x`` has a row for each item, ``bounds`` where each sequence begins and ends.
"""

from __future__ import annotations

import numpy as np


def _rounds(bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sequences from the longest to the shortest, and how many have an item at each place."""
    lengths = np.diff(bounds)
    order = np.argsort(-lengths, kind="stable")
    most = int(lengths.max()) if len(lengths) else 0
    return order, len(lengths) - np.searchsorted(np.sort(lengths), np.arange(most), side="right")


def _lse(a: np.ndarray, axis: int) -> np.ndarray:
    top = a.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(a - top).sum(axis=axis, keepdims=True))).squeeze(axis)


class Crf:
    """Weights of label 1 against label 0 for each feature, and a score for each pair of neighbouring labels."""

    def __init__(self, weights: np.ndarray, pairs: np.ndarray):
        self.weights, self.pairs = weights, pairs

    def scores(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros((len(x), 2))
        out[:, 1] = x @ self.weights
        return out

    def passes(self, x: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Forward and backward log sums of each item, all scores, log partition of each sequence."""
        s = self.scores(x)
        forward, backward = s.copy(), np.zeros_like(s)
        order, active = _rounds(bounds)
        first, last = bounds[:-1][order], bounds[1:][order] - 1
        for t in range(1, len(active)):
            at = first[: active[t]] + t
            forward[at] = s[at] + _lse(forward[at - 1][:, :, None] + self.pairs, 1)
        for t in range(len(active) - 1, 0, -1):
            at = first[: active[t]] + t
            backward[at - 1] = _lse((backward[at] + s[at])[:, None, :] + self.pairs, 2)
        total = np.zeros(len(order))
        some = np.diff(bounds)[order] > 0
        total[order[some]] = _lse(forward[last[some]], 1)
        return forward, backward, s, total

    def marginals(self, x: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each item."""
        forward, backward, _, _ = self.passes(x, bounds)
        both = forward + backward
        return 1 / (1 + np.exp(np.clip(both[:, 0] - both[:, 1], -500, 500)))

    def viterbi(self, x: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        s = self.scores(x)
        best, back = s.copy(), np.zeros((len(x), 2), np.int64)
        order, active = _rounds(bounds)
        first = bounds[:-1][order]
        for t in range(1, len(active)):
            at = first[: active[t]] + t
            step = best[at - 1][:, :, None] + self.pairs
            back[at] = step.argmax(1)
            best[at] = s[at] + step.max(1)
        label = np.zeros(len(x), np.int64)
        some = np.diff(bounds) > 0
        ends = bounds[1:][some] - 1
        label[ends] = best[ends].argmax(1)
        for t in range(len(active) - 1, 0, -1):
            at = first[: active[t]] + t
            label[at - 1] = back[at, label[at]]
        return label

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, bounds: np.ndarray, weight: np.ndarray | None = None, rounds: int = 100, rate: float = 0.2, l2: float = 1e-4) -> Crf:
        """Maximum conditional likelihood by Adam; ``weight`` counts each sequence."""
        self = cls(np.zeros(x.shape[1]), np.zeros((2, 2)))
        if not len(y):
            return self
        sequence = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
        w = (np.ones(len(bounds) - 1) if weight is None else weight)[sequence]
        inner = np.flatnonzero(sequence[1:] == sequence[:-1])
        seen = np.zeros((2, 2))
        np.add.at(seen, (y[inner], y[inner + 1]), w[inner])
        m, v = np.zeros(x.shape[1] + 4), np.zeros(x.shape[1] + 4)
        for k in range(1, rounds + 1):
            forward, backward, s, total = self.passes(x, bounds)
            both = forward + backward
            p = 1 / (1 + np.exp(np.clip(both[:, 0] - both[:, 1], -500, 500)))
            joint = forward[inner][:, :, None] + self.pairs + (s + backward)[inner + 1][:, None, :] - total[sequence[inner]][:, None, None]
            slope = np.concatenate([x.T @ (w * (y - p)) / w.sum() - l2 * self.weights, ((seen - (w[inner][:, None, None] * np.exp(joint)).sum(0)) / w.sum()).reshape(-1) - l2 * self.pairs.reshape(-1)])
            m, v = 0.9 * m + 0.1 * slope, 0.99 * v + 0.01 * slope**2
            step = rate * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-9)
            self.weights = self.weights + step[:-4]
            self.pairs = self.pairs + step[-4:].reshape(2, 2)
        return self
