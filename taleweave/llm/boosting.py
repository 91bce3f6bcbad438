"""Gradient-boosted trees for a small labelled table, scored as a DataFrame expression."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Split:
    feature: int
    cut: float
    low: Split | float
    high: Split | float


def grow(x: np.ndarray, gradient: np.ndarray, hessian: np.ndarray, depth: int, least: int, ridge: float) -> Split | float:
    """A regression tree on second-order gains; ties go to the first feature and the lowest cut."""
    leaf = float(gradient.sum() / (hessian.sum() + ridge))
    if depth == 0 or len(x) < 2 * least:
        return leaf
    gain = lambda g, h: g * g / (h + ridge)
    best, found = 1e-9, None
    for j in range(x.shape[1]):
        order = np.argsort(x[:, j], kind="stable")
        v, g, h = x[order, j], np.cumsum(gradient[order]), np.cumsum(hessian[order])
        at = np.flatnonzero(v[1:] > v[:-1])
        at = at[(at + 1 >= least) & (len(x) - at - 1 >= least)]
        if not len(at):
            continue
        won = gain(g[at], h[at]) + gain(g[-1] - g[at], h[-1] - h[at]) - gain(g[-1], h[-1])
        k = int(won.argmax())
        if won[k] > best:
            best, found = float(won[k]), (j, float((v[at[k]] + v[at[k] + 1]) / 2))
    if found is None:
        return leaf
    j, cut = found
    low = x[:, j] <= cut
    return Split(j, cut, *(grow(x[s], gradient[s], hessian[s], depth - 1, least, ridge) for s in (low, ~low)))


def value(tree: Split | float, row: np.ndarray) -> float:
    while isinstance(tree, Split):
        tree = tree.low if row[tree.feature] <= tree.cut else tree.high
    return tree


def boost(x: np.ndarray, y: np.ndarray, *, rounds: int = 40, rate: float = 0.3, depth: int = 3, least: int = 2, ridge: float = 1.0) -> list[Split | float]:
    """Trees whose sum is the log odds of ``y``."""
    mean = min(max(float(y.mean()), 1e-3), 1 - 1e-3)
    trees: list[Split | float] = [float(np.log(mean / (1 - mean)))]
    score = np.full(len(y), trees[0])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-score))
        tree = grow(x, y - p, p * (1 - p), depth, least, ridge)
        tree = scaled(tree, rate)
        trees.append(tree)
        score += [value(tree, row) for row in x]
    return trees


def scaled(tree: Split | float, rate: float) -> Split | float:
    return Split(tree.feature, tree.cut, scaled(tree.low, rate), scaled(tree.high, rate)) if isinstance(tree, Split) else tree * rate


def log_odds(trees: list[Split | float], features: list[Column]) -> Column:
    def column(tree: Split | float) -> Column:
        if not isinstance(tree, Split):
            return F.lit(tree)
        return F.when(features[tree.feature] <= tree.cut, column(tree.low)).otherwise(column(tree.high))

    total = column(trees[0])
    for tree in trees[1:]:
        total = total + column(tree)
    return total

