"""Gradient-boosted trees small enough to be written out as one column expression.

Fitted on the driver from a small labelled table (logistic loss, depth-two trees, exact
splits); applied as a sum of CASE expressions, so scoring needs nothing but columns.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass
class Node:
    feature: int = -1
    split: float = 0.0
    left: Node | None = None
    right: Node | None = None
    value: float = 0.0


@dataclass
class Boosted:
    names: list[str]
    base: float = 0.0
    trees: list[Node] = field(default_factory=list)

    def raw(self, x: np.ndarray) -> np.ndarray:
        def of(node: Node, rows: np.ndarray) -> np.ndarray:
            if node.feature < 0:
                return np.full(len(rows), node.value)
            go = rows[:, node.feature] <= node.split
            out = np.empty(len(rows))
            out[go], out[~go] = of(node.left, rows[go]), of(node.right, rows[~go])
            return out

        return self.base + sum(of(tree, x) for tree in self.trees)

    def column(self, features: dict[str, Column]) -> Column:
        """The raw score (log odds) as a column."""

        def of(node: Node) -> Column:
            if node.feature < 0:
                return F.lit(float(node.value))
            return F.when(features[self.names[node.feature]] <= node.split, of(node.left)).otherwise(of(node.right))

        out = F.lit(float(self.base))
        for tree in self.trees:
            out = out + of(tree)
        return out


def fit(x: np.ndarray, y: np.ndarray, names: list[str], rounds: int = 24, rate: float = 0.3, depth: int = 2, least: int = 4, ridge: float = 1.0) -> Boosted:
    p = np.clip(y.mean() if len(y) else 0.5, 1e-3, 1 - 1e-3)
    model = Boosted(names, float(np.log(p / (1 - p))))
    score = np.full(len(y), model.base)
    for _ in range(rounds):
        prob = 1 / (1 + np.exp(-score))
        gradient, weight = y - prob, prob * (1 - prob)

        def grow(rows: np.ndarray, level: int) -> Node:
            g, h = gradient[rows].sum(), weight[rows].sum()
            leaf = Node(value=float(rate * g / (h + ridge)))
            if level == depth or len(rows) < 2 * least:
                return leaf
            best, found = 1e-6, None
            for f in range(x.shape[1]):
                order = rows[np.argsort(x[rows, f], kind="stable")]
                v = x[order, f]
                left_g, left_h = np.cumsum(gradient[order])[:-1], np.cumsum(weight[order])[:-1]
                gain = left_g**2 / (left_h + ridge) + (g - left_g) ** 2 / (h - left_h + ridge) - g * g / (h + ridge)
                n = np.arange(1, len(rows))
                gain[(v[1:] == v[:-1]) | (n < least) | (len(rows) - n < least)] = 0
                if len(gain) and gain.max() > best:
                    best, found = gain.max(), (f, float((v[gain.argmax()] + v[gain.argmax() + 1]) / 2))
            if found is None:
                return leaf
            go = x[rows, found[0]] <= found[1]
            return Node(found[0], found[1], grow(rows[go], level + 1), grow(rows[~go], level + 1))

        tree = grow(np.arange(len(y)), 0)
        model.trees.append(tree)
        score += Boosted(names, 0.0, [tree]).raw(x)
    return model


def threshold(scores: np.ndarray, y: np.ndarray, precision: float) -> float:
    """Score from which on the share of positives is at least ``precision``, midway to the next lower one; infinity if none."""
    order = np.argsort(-scores, kind="stable")
    right = np.cumsum(y[order]) / np.arange(1, len(y) + 1)
    last_of_tie = np.append(scores[order][1:] != scores[order][:-1], True) if len(y) else np.zeros(0, bool)
    ok = np.flatnonzero((right >= precision) & last_of_tie)
    if not len(ok):
        return float("inf")
    last = ok[-1]
    return float(scores[order][last] + scores[order][min(last + 1, len(y) - 1)]) / 2
