"""Gradient-boosted trees for two classes on small tables, with calibrated probabilities."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


@dataclass
class BoostedTrees:
    """Trees of a fixed depth, grown on features in bins by second-order gain of the logistic loss."""

    rounds: int = 60
    depth: int = 3
    rate: float = 0.2
    bins: int = 32
    ridge: float = 1.0
    least: float = 4.0  # hessian that a leaf needs
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)
    base: float = 0.0
    slope: float = 1.0
    shift: float = 0.0

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        n, width = x.shape
        cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, self.bins + 1)[1:-1])) for f in range(width)]
        binned = np.stack([np.searchsorted(cuts[f], x[:, f], "left") for f in range(width)], 1)
        p = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.base, self.trees = float(np.log(p / (1 - p))), []
        score = np.full(n, self.base)
        for _ in range(self.rounds):
            prob = 1 / (1 + np.exp(-score))
            grad, hess = y - prob, prob * (1 - prob)
            feature, cut = np.full(2**self.depth - 1, -1), np.zeros(2**self.depth - 1)
            node = np.zeros(n, np.int64)
            for level in range(self.depth):
                first, many = 2**level - 1, 2**level
                best = [(1e-6, -1, 0)] * many
                for f in range(width):
                    if not len(cuts[f]):
                        continue
                    key = (node - first) * self.bins + binned[:, f]
                    g = np.bincount(key, grad, many * self.bins).reshape(many, self.bins).cumsum(1)
                    h = np.bincount(key, hess, many * self.bins).reshape(many, self.bins).cumsum(1)
                    gl, hl, gt, ht = g[:, :-1], h[:, :-1], g[:, -1:], h[:, -1:]
                    gain = gl**2 / (hl + self.ridge) + (gt - gl) ** 2 / (ht - hl + self.ridge) - gt**2 / (ht + self.ridge)
                    gain[(hl < self.least) | (ht - hl < self.least)] = 0
                    gain = gain[:, : len(cuts[f])]
                    for k in range(many):
                        b = int(gain[k].argmax())
                        if gain[k, b] > best[k][0]:
                            best[k] = (gain[k, b], f, b)
                right = np.zeros(n, np.int64)
                for k, (_, f, b) in enumerate(best):
                    if f >= 0:
                        feature[first + k], cut[first + k] = f, cuts[f][b]
                        here = node == first + k
                        right[here] = binned[here, f] > b
                node = 2 * node + 1 + right
            leaf = node - (2**self.depth - 1)
            value = self.rate * np.bincount(leaf, grad, 2**self.depth) / (np.bincount(leaf, hess, 2**self.depth) + self.ridge)
            score += value[leaf]
            self.trees.append((feature, cut, value))
        return self

    def margin(self, x: np.ndarray) -> np.ndarray:
        score, rows = np.full(len(x), self.base), np.arange(len(x))
        for feature, cut, value in self.trees:
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                f = feature[node]
                node = 2 * node + 1 + ((f >= 0) & (x[rows, f] > cut[node]))
            score += value[node - (2**self.depth - 1)]
        return score

    def calibrate(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        """Fits slope and shift of the margin to rows that the trees have not seen (Newton steps)."""
        m = self.margin(x)
        a, b = 1.0, 0.0
        for _ in range(30):
            p = 1 / (1 + np.exp(-(a * m + b)))
            w = p * (1 - p) + 1e-9
            g = np.array([((y - p) * m).sum() - 1e-2 * (a - 1), (y - p).sum() - 1e-2 * b])
            h = np.array([[(w * m * m).sum() + 1e-2, (w * m).sum()], [(w * m).sum(), w.sum() + 1e-2]])
            step = np.linalg.solve(h, g)
            a, b = a + float(np.clip(step[0], -1, 1)), b + float(np.clip(step[1], -1, 1))
        self.slope, self.shift = a, b
        return self

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.slope * self.margin(x) + self.shift)))
