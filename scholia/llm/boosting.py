"""Gradient-boosted trees for a yes-or-no target, over histograms of features, in numpy."""

from __future__ import annotations

import numpy as np

from .training import logistic


class BoostedTrees:
    """Logistic loss, second-order gains, level-wise trees of a fixed depth, each on a random ``share`` of the rows; ``fit`` then ``log_odds``."""

    def __init__(self, rounds: int = 100, depth: int = 5, rate: float = 0.2, bins: int = 32, l2: float = 1.0, least: float = 2.0, share: float = 0.4):
        self.rounds, self.depth, self.rate, self.bins, self.l2, self.least, self.share = rounds, depth, rate, bins, l2, least, share
        self.base, self.trees = 0.0, []

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        n, f = x.shape
        cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) for j in range(f)]
        binned = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], 1)
        p = np.clip(y.mean(), 1e-4, 1 - 1e-4)
        self.base = float(np.log(p / (1 - p)))
        total = np.full(n, self.base)
        cells = binned + np.arange(f) * self.bins
        rng, every, all_cells, all_y, all_total = np.random.default_rng(0), x, cells, y, total
        for _ in range(self.rounds):
            some = np.flatnonzero(rng.random(len(every)) < self.share)
            x, cells, y, total = every[some], all_cells[some], all_y[some], all_total[some]
            n = len(some)
            q = logistic(total)
            grad, hess = q - y, np.maximum(q * (1 - q), 1e-9)
            leaf, split = np.zeros(n, np.int64), []
            for level in range(self.depth):
                k = 1 << level
                at = (leaf[:, None] * (f * self.bins) + cells).ravel()
                g = np.bincount(at, np.repeat(grad, f), k * f * self.bins).reshape(k, f, self.bins).cumsum(2)
                h = np.bincount(at, np.repeat(hess, f), k * f * self.bins).reshape(k, f, self.bins).cumsum(2)
                gt, ht = g[:, :1, -1:], h[:, :1, -1:]
                gain = g**2 / (h + self.l2) + (gt - g) ** 2 / (ht - h + self.l2) - gt**2 / (ht + self.l2)
                gain[(h < self.least) | (ht - h < self.least)] = -1
                best = gain.reshape(k, -1).argmax(1)
                feature, cut = np.divmod(best, self.bins)
                none = gain.reshape(k, -1).max(1) <= 1e-6
                value = np.array([np.inf if z or c >= len(cuts[j]) else cuts[j][c] for j, c, z in zip(feature, cut, none)])
                split.append((feature, value))
                leaf = 2 * leaf + (x[np.arange(n), feature[leaf]] > value[leaf])
            k = 1 << self.depth
            value = -self.rate * np.bincount(leaf, grad, k) / (np.bincount(leaf, hess, k) + self.l2)
            self.trees.append((split, value))
            all_total += self._values(split, value, every)
        return self

    @staticmethod
    def _values(split, value, x: np.ndarray) -> np.ndarray:
        leaf, rows = np.zeros(len(x), np.int64), np.arange(len(x))
        for feature, cut in split:
            leaf = 2 * leaf + (x[rows, feature[leaf]] > cut[leaf])
        return value[leaf]

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        return self.base + sum((self._values(split, value, x) for split, value in self.trees), np.zeros(len(x)))
