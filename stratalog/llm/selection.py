"""Choosing settings of classifiers by cross-validation inside the rows that may be learned from.

Rows that are held out from learning take no part; they are read once, after the choice, to report it.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

#: What a setting's fit gives: scores from 0 to 1 of other texts.
Scorer = Callable[[list[str]], np.ndarray]


def folds(n: int, k: int, seed: int = 7) -> list[np.ndarray]:
    """k parts of the positions, as equal as they can be, the same in every run."""
    return np.array_split(np.random.default_rng(seed).permutation(n), k)


def cross_validate(texts: list[str], y: list[int], settings: dict[str, Callable[[list[str], list[int]], Scorer]], k: int = 5, threshold: float = 0.5) -> dict[str, dict[str, float]]:
    """For each setting the mean log loss, precision and recall over all rows, each scored by the fit that left its fold out."""
    out = {}
    truth = np.array(y)
    for name, fit in settings.items():
        scores = np.zeros(len(texts))
        for part in folds(len(texts), k):
            rest = np.setdiff1d(np.arange(len(texts)), part)
            scores[part] = fit([texts[i] for i in rest], [y[i] for i in rest])([texts[i] for i in part])
        p = np.clip(scores, 1e-6, 1 - 1e-6)
        found = scores >= threshold
        hit = float((found & (truth == 1)).sum())
        out[name] = {
            "loss": float(-(truth * np.log(p) + (1 - truth) * np.log(1 - p)).mean()), "precision": hit / max(1.0, float(found.sum())), "recall": hit / max(1.0, float((truth == 1).sum())),
        }
    return out


def best(results: dict[str, dict[str, float]]) -> str:
    """The setting of the least loss, the first of equal ones."""
    return min(results, key=lambda name: results[name]["loss"])
