"""Gradient-boosted trees for binary decisions over a few numeric features, in numpy; small enough to ship with a function."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


@dataclass
class Boosted:
    """Logistic boosting with depth-limited trees over binned features."""

    rounds: int = 40
    depth: int = 3
    rate: float = 0.3
    bins: int = 32
    least: float = 1.0
    ridge: float = 1.0
    base: float = 0.0
    #: Trees as lists of (feature, threshold, left, right, value); feature -1 is a leaf.
    trees: list[list[tuple[int, float, int, int, float]]] = field(default_factory=list)

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None) -> Boosted:
        """Rows x features, 0/1 labels. With labels of one kind only the base rate is learned."""
        x = np.asarray(x, float)
        y = np.asarray(y, float)
        w = np.ones(len(y)) if weight is None else np.asarray(weight, float)
        p = float(np.clip((w @ y + 0.5) / (w.sum() + 1.0), 1e-3, 1 - 1e-3))
        self.base, self.trees = float(np.log(p / (1 - p))), []
        if len(np.unique(y)) < 2:
            return self
        cuts = [np.unique(np.quantile(c, np.linspace(0, 1, self.bins + 1)[1:-1])) if len(np.unique(c)) > self.bins else (lambda u: (u[1:] + u[:-1]) / 2)(np.unique(c)) for c in x.T]
        code = np.stack([np.searchsorted(c, col, side="left") for c, col in zip(cuts, x.T)], axis=1)
        score = np.full(len(y), self.base)
        for _ in range(self.rounds):
            prob = 1 / (1 + np.exp(-score))
            g, h = w * (y - prob), w * prob * (1 - prob)
            tree: list[tuple[int, float, int, int, float]] = []
            self._grow(code, cuts, g, h, np.arange(len(y)), 0, tree, score)
            if len(tree) < 2:
                break
            self.trees.append(tree)
        return self

    def _grow(self, code, cuts, g, h, rows, level, tree, score) -> int:
        at = len(tree)
        tree.append((-1, 0.0, 0, 0, 0.0))
        sg, sh = g[rows].sum(), h[rows].sum()
        best = (1e-6, -1, 0)
        if level < self.depth and len(rows) > 1:
            for f, c in enumerate(cuts):
                if not len(c):
                    continue
                gs = np.bincount(code[rows, f], g[rows], len(c) + 1).cumsum()[:-1]
                hs = np.bincount(code[rows, f], h[rows], len(c) + 1).cumsum()[:-1]
                ok = (hs >= self.least * 0.1) & (sh - hs >= self.least * 0.1)
                gain = np.where(ok, gs**2 / (hs + self.ridge) + (sg - gs) ** 2 / (sh - hs + self.ridge) - sg**2 / (sh + self.ridge), -1)
                k = int(gain.argmax())
                if gain[k] > best[0]:
                    best = (float(gain[k]), f, k)
        if best[1] < 0:
            value = float(self.rate * sg / (sh + self.ridge))
            score[rows] += value
            tree[at] = (-1, 0.0, 0, 0, value)
            return at
        _, f, k = best
        left = code[rows, f] <= k
        a = self._grow(code, cuts, g, h, rows[left], level + 1, tree, score)
        b = self._grow(code, cuts, g, h, rows[~left], level + 1, tree, score)
        tree[at] = (f, float(cuts[f][k]), a, b, 0.0)
        return at

    def probability(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row."""
        x = np.asarray(x, float)
        score = np.full(len(x), self.base)
        for tree in self.trees:
            node = np.zeros(len(x), int)
            f = np.array([t[0] for t in tree])
            cut = np.array([t[1] for t in tree])
            nxt = np.array([[t[2], t[3]] for t in tree])
            value = np.array([t[4] for t in tree])
            for _ in range(self.depth):
                inner = f[node] >= 0
                if not inner.any():
                    break
                go = x[np.arange(len(x)), np.maximum(f[node], 0)] > cut[node]
                node = np.where(inner, nxt[node, go.astype(int)], node)
            score += value[node]
        return 1 / (1 + np.exp(-np.clip(score, -40, 40)))
