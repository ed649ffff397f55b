"""Gradient-boosted regression trees for a two-class logistic loss, on binned features."""

from __future__ import annotations

import numpy as np


class Boosted:
    """``trees``: (feature, cut, value) arrays of complete binary trees of one depth."""

    def __init__(self, depth: int = 4, rounds: int = 60, rate: float = 0.2, bins: int = 32, least: float = 8.0, columns: float = 0.4):
        self.depth, self.rounds, self.rate, self.bins, self.least, self.columns = depth, rounds, rate, bins, least, columns
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.bias = 0.0

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> Boosted:
        n, every = x.shape
        m = max(1, int(self.columns * every))
        random = np.random.default_rng(7)
        cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins)[1:-1])) for j in range(every)]
        binned = np.stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(cuts)], 1)  # bin b: cuts[b-1] < value <= cuts[b]
        share = np.average(y, weights=weight)
        self.bias = float(np.log(share / (1 - share)))
        score = np.full(n, self.bias)
        offset = np.arange(m) * self.bins
        for _ in range(self.rounds):
            some = random.permutation(every)[:m]
            part = offset + binned[:, some]
            p = 1 / (1 + np.exp(-score))
            g, h = weight * (y - p), weight * p * (1 - p)
            node = np.zeros(n, np.int64)
            feature, cut = np.zeros(2**self.depth - 1, np.int64), np.full(2**self.depth - 1, np.inf)
            for level in range(self.depth):
                first, width = 2**level - 1, 2**level
                key = (node[:, None] * m * self.bins + part).ravel()
                size = width * m * self.bins
                sums = [np.bincount(key, np.repeat(v, m), size).reshape(width, m, self.bins) for v in (g, h)]
                left = [s.cumsum(2)[:, :, :-1] for s in sums]
                whole = [s[:, :1].sum(2, keepdims=True) for s in sums]
                right = [w - a for w, a in zip(whole, left, strict=True)]
                gain = sum(a[0] ** 2 / (a[1] + 1) for a in (left, right)) - whole[0] ** 2 / (whole[1] + 1)
                gain[(left[1] < self.least) | (right[1] < self.least)] = -1
                best = gain.reshape(width, -1).argmax(1)
                for k, b in enumerate(best.tolist()):
                    j, c = divmod(b, self.bins - 1)
                    j = some[j]
                    if gain.reshape(width, -1)[k, b] > 1e-9 and c < len(cuts[j]):
                        feature[first + k], cut[first + k] = j, cuts[j][c]
                node = 2 * node + (x[np.arange(n), feature[first + node]] > cut[first + node])
            g_sum, h_sum = (np.bincount(node, v, 2**self.depth) for v in (g, h))
            value = self.rate * g_sum / (h_sum + 1)
            score += value[node]
            self.trees.append((feature, cut, value))
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        score = np.full(len(x), self.bias)
        rows = np.arange(len(x))
        for feature, cut, value in self.trees:
            node = np.zeros(len(x), np.int64)
            for level in range(self.depth):
                at = 2**level - 1 + node
                node = 2 * node + (x[rows, feature[at]] > cut[at])
            score += value[node]
        return 1 / (1 + np.exp(-score))
