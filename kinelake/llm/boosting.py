"""Gradient-boosted regression trees for log-odds, in numpy: Newton steps, features cut at quantiles."""

from __future__ import annotations

import numpy as np


class Boosting:
    def __init__(self, rounds: int = 60, depth: int = 3, rate: float = 0.2, penalty: float = 1.0, cuts: int = 16):
        self.rounds, self.depth, self.rate, self.penalty, self.cuts = rounds, depth, rate, penalty, cuts
        self.start, self.trees = 0.0, []

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosting:
        prior = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.start = float(np.log(prior / (1 - prior)))
        cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.cuts + 1)[1:-1], method="lower")) for j in range(x.shape[1])]
        raw = np.full(len(y), self.start)
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-raw))
            tree: list[tuple] = []
            raw = raw + self._grow(x, y - p, p * (1 - p), np.arange(len(y)), self.depth, cuts, tree)
            self.trees.append(tree)
        return self

    def _grow(self, x, g, h, rows, depth, cuts, tree) -> np.ndarray:
        """Appends the subtree over rows; its values, for all rows of x (0 elsewhere)."""
        out = np.zeros(len(g))
        total_g, total_h = g[rows].sum(), h[rows].sum()
        best = (1e-6, None, None)
        if depth:
            for j, c in enumerate(cuts):
                if len(c):
                    where = np.searchsorted(c, x[rows, j], "left")
                    sg, sh = np.bincount(where, g[rows], len(c) + 1).cumsum()[:-1], np.bincount(where, h[rows], len(c) + 1).cumsum()[:-1]
                    gain = sg**2 / (sh + self.penalty) + (total_g - sg) ** 2 / (total_h - sh + self.penalty) - total_g**2 / (total_h + self.penalty)
                    k = int(gain.argmax())
                    if gain[k] > best[0]:
                        best = (float(gain[k]), j, float(c[k]))
        node = len(tree)
        if best[1] is None:
            value = float(self.rate * total_g / (total_h + self.penalty))
            tree.append((-1, value, -1, -1))
            out[rows] = value
            return out
        _, j, cut = best
        tree.append(None)
        left = x[rows, j] <= cut
        a = len(tree)
        out += self._grow(x, g, h, rows[left], depth - 1, cuts, tree)
        b = len(tree)
        out += self._grow(x, g, h, rows[~left], depth - 1, cuts, tree)
        tree[node] = (j, cut, a, b)
        return out

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.start)
        for tree in self.trees:
            stack = [(0, np.arange(len(x)))]
            while stack:
                k, rows = stack.pop()
                j, v, a, b = tree[k]
                if j < 0:
                    out[rows] += v
                else:
                    left = x[rows, j] <= v
                    stack += [(a, rows[left]), (b, rows[~left])]
        return out
