"""Small gradient boosting for a few thousand labelled rows, scored as SQL.

Fitting is on the driver over a bounded table of whole-number features; a fitted model becomes a Column of CASE
expressions, so that scoring stays inside Spark.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass
class Boosted:
    """Logistic loss, second-order leaf values, depth-limited trees over thresholds."""

    rounds: int = 30
    depth: int = 3
    rate: float = 0.3
    damping: float = 1.0
    least: int = 5
    bias: float = 0.0
    trees: list = field(default_factory=list)

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        p = min(max(y.mean(), 1e-3), 1 - 1e-3)
        self.bias, self.trees = float(np.log(p / (1 - p))), []
        score = np.full(len(y), self.bias)
        for _ in range(self.rounds):
            q = 1 / (1 + np.exp(-score))
            tree = self._grow(x, q - y, q * (1 - q), np.arange(len(y)), self.depth)
            self.trees.append(tree)
            score = score + self._walk(tree, x)
        return self

    def _grow(self, x, g, h, rows, depth):
        leaf = {"value": float(-self.rate * g[rows].sum() / (h[rows].sum() + self.damping))}
        if not depth or len(rows) < 2 * self.least:
            return leaf
        best, all_g, all_h = None, g[rows].sum(), h[rows].sum()
        for k in range(x.shape[1]):
            v = x[rows, k]
            for cut in np.unique(v)[:-1]:
                left = v <= cut
                if self.least <= left.sum() <= len(rows) - self.least:
                    lg, lh = g[rows][left].sum(), h[rows][left].sum()
                    gain = lg**2 / (lh + self.damping) + (all_g - lg) ** 2 / (all_h - lh + self.damping) - all_g**2 / (all_h + self.damping)
                    if gain > 1e-6 and (best is None or gain > best[0] + 1e-12):
                        best = gain, k, float(cut), left
        if best is None:
            return leaf
        _, k, cut, left = best
        return {"feature": k, "cut": cut, "low": self._grow(x, g, h, rows[left], depth - 1), "high": self._grow(x, g, h, rows[~left], depth - 1)}

    def _walk(self, tree, x):
        if "value" in tree:
            return np.full(len(x), tree["value"])
        return np.where(x[:, tree["feature"]] <= tree["cut"], self._walk(tree["low"], x), self._walk(tree["high"], x))

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.bias + sum(self._walk(t, x) for t in self.trees))))

    def column(self, feature) -> Column:
        """The probability as a Column; ``feature(k)`` gives the k-th feature."""

        def case(tree) -> Column:
            if "value" in tree:
                return F.lit(tree["value"])
            return F.when(feature(tree["feature"]) <= tree["cut"], case(tree["low"])).otherwise(case(tree["high"]))

        total = F.lit(self.bias)
        for t in self.trees:
            total = total + case(t)
        return 1 / (1 + F.exp(-total))


def threshold(probability: np.ndarray, y: np.ndarray, precision: float) -> float:
    """The lowest cut at which held-out precision is at least the one asked for; over 1 (nothing passes) if there is none."""
    order = np.argsort(-probability, kind="stable")
    p, right = probability[order], np.cumsum(y[order])
    fine = right / np.arange(1, len(p) + 1) >= precision
    last = np.append(p[1:] != p[:-1], True)  # cuts between equal scores don't exist
    ok = np.nonzero(fine & last)[0]
    return float(p[ok[-1]]) if len(ok) else 1.1
