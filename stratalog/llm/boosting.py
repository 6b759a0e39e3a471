"""Small gradient-boosted trees for binary labels, in numpy, with calibrated probabilities."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Tree:
    """A full binary tree: inner nodes hold feature and cut, leaves a value; node i has children 2i+1, 2i+2."""

    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray
    depth: int

    def predict(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), dtype=np.int64)
        rows = np.arange(len(x))
        for _ in range(self.depth):
            at = 2 * at + 1 + (x[rows, self.feature[at]] > self.cut[at])
        return self.value[at - (2**self.depth - 1)]


def grow(x: np.ndarray, grad: np.ndarray, hess: np.ndarray, depth: int, cuts: list[np.ndarray], ridge: float) -> Tree:
    """Greedy splits on fixed cuts by the gain of second-order boosting; a node without gain repeats its value."""
    inner = 2**depth - 1
    feature, cut = np.zeros(inner, dtype=np.int64), np.full(inner, np.inf)
    at = np.zeros(len(x), dtype=np.int64)
    for node in range(inner):
        rows = np.flatnonzero(at == node)
        if len(rows) >= 8:
            g, h = grad[rows], hess[rows]
            base, best = g.sum() ** 2 / (h.sum() + ridge), 1e-6
            for f, values in enumerate(cuts):
                right = x[rows, f][:, None] > values
                gr, hr = g @ right, h @ right
                gain = gr**2 / (hr + ridge) + (g.sum() - gr) ** 2 / (h.sum() - hr + ridge) - base
                if len(gain) and gain.max() > best:
                    best, feature[node], cut[node] = gain.max(), f, values[gain.argmax()]
        at[rows] = 2 * node + 1 + (x[rows, feature[node]] > cut[node])
    leaf = at - inner
    g = np.bincount(leaf, grad, minlength=inner + 1)
    h = np.bincount(leaf, hess, minlength=inner + 1)
    return Tree(feature, cut, -g / (h + ridge), depth)


@dataclass
class Boosted:
    trees: list[Tree]
    rate: float
    start: float
    slope: float = 1.0  # calibration of the logit
    shift: float = 0.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.start)
        for t in self.trees:
            out += self.rate * t.predict(x)
        return out

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.logits(x) + self.shift, -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, own: np.ndarray, rest: np.ndarray, trees: int = 60, depth: int = 3, rate: float = 0.2, ridge: float = 1.0) -> Boosted:
    """Boosted trees on the rows ``own``, a Platt calibration on the rows ``rest``."""
    cuts = []
    for f in range(x.shape[1]):
        v = np.unique(x[own, f])
        mid = (v[1:] + v[:-1]) / 2
        cuts.append(mid if len(mid) <= 32 else np.unique(np.quantile(mid, np.linspace(0, 1, 32))))
    p = np.clip(y[own].mean(), 1e-3, 1 - 1e-3)
    out = Boosted([], rate, float(np.log(p / (1 - p))))
    z = np.full(own.sum(), out.start)
    for _ in range(trees):
        s = 1 / (1 + np.exp(-z))
        tree = grow(x[own], s - y[own], s * (1 - s), depth, cuts, ridge)
        z += rate * tree.predict(x[own])
        out.trees.append(tree)
    raw = out.logits(x[rest])
    a, b = 1.0, 0.0
    for _ in range(100):
        s = 1 / (1 + np.exp(-np.clip(a * raw + b, -30, 30)))
        w = s * (1 - s) + 1e-6
        grad = np.array([((s - y[rest]) * raw).sum() + (a - 1), (s - y[rest]).sum() + 0.1 * b])
        hess = np.array([[(w * raw * raw).sum() + 1, (w * raw).sum()], [(w * raw).sum(), w.sum() + 0.1]])
        step = np.linalg.solve(hess, grad)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-8:
            break
    out.slope, out.shift = float(a), float(b)
    return out
