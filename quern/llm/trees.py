"""Gradient-boosted symmetric trees on binned features, in numpy."""

from __future__ import annotations

import numpy as np


class BoostedTrees:
    """Logistic loss; every level of a tree asks one question of all rows, so prediction is a handful of array steps."""

    def __init__(self, trees: int = 50, depth: int = 5, rate: float = 0.25, bins: int = 32, l2: float = 2.0):
        self.trees, self.depth, self.rate, self.bins, self.l2 = trees, depth, rate, bins, l2
        self.base = 0.0
        self.features = np.zeros((0, depth), np.int64)
        self.cuts = np.zeros((0, depth))
        self.leaves = np.zeros((0, 1 << depth))

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        n, m = x.shape
        edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) for j in range(m)]
        codes = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], 1).astype(np.int64)
        p = min(max(y.mean(), 1e-3), 1 - 1e-3)
        self.base = float(np.log(p / (1 - p)))
        f = np.full(n, self.base)
        features, cuts, leaves = [], [], []
        for _ in range(self.trees):
            prob = 1 / (1 + np.exp(-f))
            g, h = y - prob, np.maximum(prob * (1 - prob), 1e-6)
            leaf = np.zeros(n, np.int64)
            fs, cs = [], []
            for level in range(self.depth):
                width = self.bins * (1 << level)
                best = (-np.inf, 0, 0)
                for j in range(m):
                    if not len(edges[j]):
                        continue
                    at = leaf * self.bins + codes[:, j]
                    gs = np.bincount(at, g, width).reshape(-1, self.bins)
                    hs = np.bincount(at, h, width).reshape(-1, self.bins)
                    gl, hl = gs.cumsum(1), hs.cumsum(1)
                    gt, ht = gl[:, -1:], hl[:, -1:]
                    gain = (gl**2 / (hl + self.l2) + (gt - gl) ** 2 / (ht - hl + self.l2)).sum(0)[: len(edges[j])]
                    k = int(gain.argmax())
                    if gain[k] > best[0]:
                        best = (float(gain[k]), j, k)
                _, j, k = best
                fs.append(j)
                cs.append(edges[j][k] if len(edges[j]) else 0.0)
                leaf = leaf * 2 + (x[:, j] > cs[-1])
            size = 1 << self.depth
            values = self.rate * np.bincount(leaf, g, size) / (np.bincount(leaf, h, size) + self.l2)
            f += values[leaf]
            features.append(fs)
            cuts.append(cs)
            leaves.append(values)
        self.features, self.cuts, self.leaves = np.array(features), np.array(cuts), np.array(leaves)
        return self

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        f = np.full(len(x), self.base)
        columns = np.ascontiguousarray(x.T)
        for fs, cs, values in zip(self.features, self.cuts, self.leaves):
            leaf = np.zeros(len(x), np.int64)
            for j, c in zip(fs, cs):
                leaf = leaf * 2 + (columns[j] > c)
            f += values[leaf]
        return f
