"""Small gradient-boosted trees: fitted by numpy on a bounded table of features, scored as a column expression."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Split:
    """Rows with feature <= cut go to `low`, others to `high`; leaves are numbers."""

    feature: int
    cut: float
    low: object
    high: object


@dataclass(frozen=True)
class Boosted:
    features: tuple[str, ...]
    base: float
    trees: tuple[object, ...]
    threshold: float

    def predict(self, x: np.ndarray) -> np.ndarray:
        def run(node, rows):
            if not isinstance(node, Split):
                return np.full(len(rows), float(node))
            left = rows[:, node.feature] <= node.cut
            out = np.empty(len(rows))
            out[left], out[~left] = run(node.low, rows[left]), run(node.high, rows[~left])
            return out

        return 1 / (1 + np.exp(-(self.base + sum(run(t, x) for t in self.trees))))

    def column(self, value: dict[str, Column]) -> Column:
        """The probability as a column, from the features' columns."""

        def run(node) -> Column:
            if not isinstance(node, Split):
                return F.lit(float(node))
            return F.when(value[self.features[node.feature]] <= node.cut, run(node.low)).otherwise(run(node.high))

        total = F.lit(float(self.base))
        for t in self.trees:
            total = total + run(t)
        return 1 / (1 + F.exp(-total))


def _grow(x: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int, rate: float, smooth: float):
    total_g, total_h = g.sum(), h.sum()
    leaf = rate * total_g / (total_h + smooth)
    if depth == 0 or len(g) < 4:
        return leaf
    best = (1e-9, None, None)
    for f in range(x.shape[1]):
        for cut in np.unique(x[:, f])[:-1]:
            left = x[:, f] <= cut
            gl, hl = g[left].sum(), h[left].sum()
            gain = gl * gl / (hl + smooth) + (total_g - gl) ** 2 / (total_h - hl + smooth) - total_g**2 / (total_h + smooth)
            if gain > best[0]:
                best = (gain, f, float(cut))
    if best[1] is None:
        return leaf
    left = x[:, best[1]] <= best[2]
    return Split(best[1], best[2], _grow(x[left], g[left], h[left], depth - 1, rate, smooth), _grow(x[~left], g[~left], h[~left], depth - 1, rate, smooth))


def fit(x: np.ndarray, y: np.ndarray, features: list[str], rounds: int = 12, depth: int = 2, rate: float = 0.5, precision: float = 0.99) -> Boosted:
    """Logistic boosting on the even rows; the threshold is calibrated on the odd ones.

    The threshold is the least score above which the odd rows hold at least `precision` positives, halfway to the
    next lower score, and 0.5 at least.
    """
    train, held = slice(0, None, 2), slice(1, None, 2)
    p0 = float(np.clip(y[train].mean(), 0.01, 0.99))
    base, score, trees = float(np.log(p0 / (1 - p0))), np.full(len(y[train]), np.log(p0 / (1 - p0))), []
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-score))
        tree = _grow(x[train], y[train] - p, p * (1 - p), depth, rate, 1.0)
        trees.append(tree)
        score = score + np.log(1 / (1 / Boosted(tuple(features), 0.0, (tree,), 0).predict(x[train]) - 1))
    model = Boosted(tuple(features), base, tuple(trees), 0.5)
    p, truth = model.predict(x[held]), y[held]
    order = np.argsort(-p, kind="stable")
    kept = np.cumsum(truth[order]) / np.arange(1, len(order) + 1)
    good = np.flatnonzero(kept >= precision)
    least = p[order][good[-1]] if len(good) else 1.0
    below = p[order][p[order] < least]
    cut = (least + (below[0] if len(below) else 0)) / 2
    return Boosted(model.features, base, model.trees, float(max(0.5, cut)))
