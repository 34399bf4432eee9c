"""Gradient-boosted trees on a bounded sample, as arrays and as Spark expressions."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Leaf:
    value: float


@dataclass(frozen=True)
class Split:
    """Rows with ``feature < edge`` go to ``low``."""

    feature: int
    edge: float
    low: Split | Leaf
    high: Split | Leaf


@dataclass(frozen=True)
class Boosted:
    """log odds = base + the trees' leaves, added in order."""

    features: tuple[str, ...] = ()
    base: float = 0.0
    trees: tuple[Split | Leaf, ...] = ()

    def score(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        for tree in self.trees:
            out = out + _values(tree, x)
        return out

    def column(self) -> Column:
        """The score of a row that has the features as columns."""
        out = F.lit(self.base)
        for tree in self.trees:
            out = out + _expression(tree, self.features)
        return out


def _values(tree: Split | Leaf, x: np.ndarray) -> np.ndarray:
    if isinstance(tree, Leaf):
        return np.full(len(x), tree.value)
    return np.where(x[:, tree.feature] < tree.edge, _values(tree.low, x), _values(tree.high, x))


def _expression(tree: Split | Leaf, names: tuple[str, ...]) -> Column:
    if isinstance(tree, Leaf):
        return F.lit(tree.value)
    return F.when(F.col(names[tree.feature]) < tree.edge, _expression(tree.low, names)).otherwise(_expression(tree.high, names))


def boosted(x: np.ndarray, y: np.ndarray, features: tuple[str, ...], base: float, trees: int = 60, depth: int = 3, rate: float = 0.2, least: int = 10, bins: int = 32, ridge: float = 1.0) -> Boosted:
    """Trees for the logistic loss: splits at up to ``bins`` quantiles, by second-order gain, with
    ``least`` rows a leaf; leaves are Newton steps times ``rate``.  ``base``: log odds to begin with.

    Ties go to the first feature and edge, so that equal samples give equal trees."""
    edges = [np.unique(np.quantile(column, np.linspace(0, 1, bins + 1)[1:-1], method="higher")) for column in x.T]
    binned = [np.searchsorted(e, column, side="right") for e, column in zip(edges, x.T)]
    score, held = np.full(len(y), base), []

    def grow(rows: np.ndarray, left: int) -> Split | Leaf:
        g, h = grad[rows], hess[rows]
        total_g, total_h = g.sum(), h.sum()
        best, where = 1e-9, None
        if left and len(rows) >= 2 * least:
            for j, e in enumerate(edges):
                b = binned[j][rows]
                sums = [np.cumsum(np.bincount(b, w, len(e) + 1))[:-1] for w in (g, h, None)]
                gl, hl, n = sums
                gain = gl**2 / (hl + ridge) + (total_g - gl) ** 2 / (total_h - hl + ridge) - total_g**2 / (total_h + ridge)
                gain[(n < least) | (len(rows) - n < least)] = 0
                if len(gain) and gain.max() > best:
                    best, where = gain.max(), (j, int(gain.argmax()))
        if where is None:
            value = float(rate * total_g / (total_h + ridge))
            score[rows] += value
            return Leaf(value)
        j, k = where
        low = binned[j][rows] <= k
        return Split(j, float(edges[j][k]), grow(rows[low], left - 1), grow(rows[~low], left - 1))

    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        grad, hess = y - p, p * (1 - p)
        held.append(grow(np.arange(len(y)), depth))
    return Boosted(features, base, tuple(held))
