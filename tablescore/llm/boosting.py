"""Gradient-boosted regression trees with logistic loss, small and deterministic, and a calibrated threshold."""

from __future__ import annotations

import numpy as np


class Boosted:
    """Trees over a few features; splits are sought at quantiles of each."""

    def __init__(self, rounds: int = 60, depth: int = 3, rate: float = 0.3, bins: int = 16, ridge: float = 1.0):
        self.rounds, self.depth, self.rate, self.bins, self.ridge = rounds, depth, rate, bins, ridge
        self.base = 0.0
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.scale = (1.0, 0.0)

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        cuts = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, self.bins + 1)[1:-1])) for k in range(x.shape[1])]
        code = np.stack([np.searchsorted(c, x[:, k], side="left") for k, c in enumerate(cuts)], axis=1)
        mean = np.clip(y.mean(), 1e-6, 1 - 1e-6)
        self.base = float(np.log(mean / (1 - mean)))
        f = np.full(len(y), self.base)
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-f))
            feature, threshold, value, at = self.tree(code, cuts, y - p, p * (1 - p))
            self.trees.append((feature, threshold, value))
            f += value[at]
        return self

    def tree(self, code: np.ndarray, cuts: list[np.ndarray], grad: np.ndarray, hess: np.ndarray) -> tuple:
        """A full binary tree in heap order: feature -1 stops; value holds the leaves' steps."""
        nodes = 2 ** (self.depth + 1) - 1
        feature, threshold, value = np.full(nodes, -1), np.zeros(nodes), np.zeros(nodes)
        at = np.zeros(len(grad), dtype=np.int64)
        for node in range(nodes):
            own = np.flatnonzero(at == node)
            g, h = grad[own], hess[own]
            value[node] = self.rate * g.sum() / (h.sum() + self.ridge)
            if node >= nodes // 2 or len(own) < 8:
                continue
            best = (1e-9, -1, 0)
            whole = g.sum() ** 2 / (h.sum() + self.ridge)
            for k, c in enumerate(cuts):
                gs = np.cumsum(np.bincount(code[own, k], g, len(c) + 1))[:-1]
                hs = np.cumsum(np.bincount(code[own, k], h, len(c) + 1))[:-1]
                gain = gs**2 / (hs + self.ridge) + (g.sum() - gs) ** 2 / (h.sum() - hs + self.ridge) - whole
                if len(gain) and gain.max() > best[0]:
                    best = (float(gain.max()), k, int(gain.argmax()))
            if best[1] >= 0:
                feature[node], threshold[node] = best[1], cuts[best[1]][best[2]]
                at[own] = 2 * node + 1 + (code[own, best[1]] > best[2])
        return feature, threshold, value, at

    def margin(self, x: np.ndarray) -> np.ndarray:
        f = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, threshold, value in self.trees:
            at = np.zeros(len(x), dtype=np.int64)
            for _ in range(self.depth):
                go = feature[at] >= 0
                at = np.where(go, 2 * at + 1 + (x[rows, np.maximum(feature[at], 0)] > threshold[at]), at)
            f += value[at]
        return f

    def calibrate(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        """Fit the slope and offset between margin and log-odds on other rows (Newton steps)."""
        m = self.margin(x)
        a, b = 1.0, 0.0
        for _ in range(50):
            p = 1 / (1 + np.exp(-(a * m + b)))
            w = p * (1 - p)
            g = np.array([((y - p) * m).sum() - 1e-3 * (a - 1), (y - p).sum()])
            h = np.array([[(w * m * m).sum() + 1e-3, (w * m).sum()], [(w * m).sum(), w.sum() + 1e-3]])
            step = np.linalg.solve(h, g)
            a, b = a + step[0], b + step[1]
        self.scale = (float(a), float(b))
        return self

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale[0] * self.margin(x) + self.scale[1], -40, 40)))


def least_threshold(p: np.ndarray, y: np.ndarray, precision: float) -> float:
    """The lowest threshold from which on the rows at or above it reach the precision; above 1 if none does."""
    order = np.argsort(-p, kind="stable")
    right = np.cumsum(y[order]) / np.arange(1, len(y) + 1)
    last = np.append(p[order][1:] != p[order][:-1], True)
    good = np.flatnonzero((right >= precision) & last)
    return float(p[order][good[-1]]) if len(good) else 2.0
