"""Boosted trees of depth two over a table of category counts.

Candidates with equal categories are alike to the trees, so the fit needs the counts of each combination only: a table
bounded by the product of the category sizes, whatever the number of candidates. The trees are applied as nested
conditions.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

Tree = tuple[tuple[int, int], float, float, float, float] | tuple


def fit(x: np.ndarray, positive: np.ndarray, total: np.ndarray, rounds: int = 40, rate: float = 0.3, ridge: float = 1.0) -> tuple[float, list]:
    """x: categories (rows x features); counts of positives and of all. Returns the bias and trees (condition, left, right),
    where a side is a value or (condition, value, value) and a condition (feature, value) asks for equality."""
    bias = float(np.log((positive.sum() + 0.5) / (total.sum() - positive.sum() + 0.5)))
    conditions = [(f, int(v)) for f in range(x.shape[1]) for v in np.unique(x[:, f])]
    masks = np.array([x[:, f] == v for f, v in conditions]) if len(x) else np.zeros((0, 0), bool)
    score, trees = np.full(len(x), bias), []

    def value(g, h):
        return float(rate * g.sum() / (h.sum() + ridge))

    def gain(g, h):
        return g ** 2 / (h + ridge)

    def split(rows, g, h):
        """The condition with the largest gain on those rows, or None."""
        inside = masks[:, rows]
        gi, hi = inside @ g[rows], inside @ h[rows]
        ga, ha = g[rows].sum(), h[rows].sum()
        gains = gain(gi, hi) + gain(ga - gi, ha - hi) - gain(ga, ha)
        k = int(gains.argmax()) if len(gains) else -1
        return None if k < 0 or gains[k] <= 1e-6 else k

    for _ in range(rounds if len(conditions) else 0):
        p = 1 / (1 + np.exp(-score))
        g, h = positive - total * p, total * p * (1 - p)
        k = split(np.arange(len(x)), g, h)
        if k is None:
            break
        sides = []
        for rows in (np.flatnonzero(masks[k]), np.flatnonzero(~masks[k])):
            j = split(rows, g, h)
            if j is None:
                sides.append(v := value(g[rows], h[rows]))
                score[rows] += v
                continue
            yes, no = rows[masks[j][rows]], rows[~masks[j][rows]]
            a, b = value(g[yes], h[yes]), value(g[no], h[no])
            score[yes] += a
            score[no] += b
            sides.append((conditions[j], a, b))
        trees.append((conditions[k], *sides))
    return bias, trees


def predict(x: np.ndarray, bias: float, trees: list) -> np.ndarray:
    def side(s, x):
        return np.where(x[:, s[0][0]] == s[0][1], s[1], s[2]) if isinstance(s, tuple) else np.full(len(x), s)

    score = np.full(len(x), bias)
    for (f, v), yes, no in trees:
        score += np.where(x[:, f] == v, side(yes, x), side(no, x))
    return score


def as_column(features: list[Column], bias: float, trees: list) -> Column:
    def test(condition):
        return features[condition[0]] == condition[1]

    def side(s):
        return F.when(test(s[0]), F.lit(s[1])).otherwise(F.lit(s[2])) if isinstance(s, tuple) else F.lit(s)

    out = F.lit(bias)
    for condition, yes, no in trees:
        out = out + F.when(test(condition), side(yes)).otherwise(side(no))
    return out
