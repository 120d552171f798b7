"""A random forest small enough to become a column expression."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

Tree = float | tuple[int, float, "Tree", "Tree"]


def best_split(x: np.ndarray, y: np.ndarray, columns: np.ndarray, least: int) -> tuple[int, float] | None:
    """Column and threshold (left: at most) with the lowest weighted Gini impurity."""
    best, found = np.inf, None
    for c in columns:
        order = np.argsort(x[:, c], kind="stable")
        v, ones = x[order, c], np.cumsum(y[order])
        cut = np.flatnonzero(v[1:] > v[:-1]) + 1
        cut = cut[(cut >= least) & (cut <= len(y) - least)]
        if not len(cut):
            continue
        left, right = ones[cut - 1], ones[-1] - ones[cut - 1]
        impurity = left * (1 - left / cut) + right * (1 - right / (len(y) - cut))
        at = int(np.argmin(impurity))
        if impurity[at] < best:
            best, found = impurity[at], (int(c), float((v[cut[at] - 1] + v[cut[at]]) / 2))
    return found


def grow(x: np.ndarray, y: np.ndarray, rng: np.random.Generator, depth: int, least: int = 5) -> Tree:
    share = float((y.sum() + 0.5) / (len(y) + 1))
    if depth == 0 or y.min() == y.max():
        return share
    columns = rng.choice(x.shape[1], max(2, int(x.shape[1] ** 0.5)), replace=False)
    split = best_split(x, y, columns, least) or best_split(x, y, np.arange(x.shape[1]), least)
    if split is None:
        return share
    c, at = split
    low = x[:, c] <= at
    return c, at, grow(x[low], y[low], rng, depth - 1, least), grow(x[~low], y[~low], rng, depth - 1, least)


def fit(x: np.ndarray, y: np.ndarray, trees: int = 24, depth: int = 5, seed: int = 7) -> list[Tree]:
    rng = np.random.default_rng(seed)
    forest = []
    for _ in range(trees):
        rows = rng.integers(0, len(y), len(y))
        forest.append(grow(x[rows], y[rows], rng, depth))
    return forest


def score(forest: list[Tree], row: list[float]) -> float:
    total = 0.0
    for tree in forest:
        while isinstance(tree, tuple):
            c, at, low, high = tree
            tree = low if row[c] <= at else high
        total += tree
    return total / len(forest)


def column(forest: list[Tree], names: list[str]) -> Column:
    """The forest's score as an expression over columns of those names.

    All nodes are rows of four constant arrays; each tree is a fold that steps from its root as
    often as the deepest tree is deep (a leaf steps to itself). The expression thus stays small,
    whatever the forest's size.
    """
    columns, limits, lows, highs = [], [], [], []

    def add(tree: Tree) -> tuple[int, int]:
        at = len(columns)
        columns.append(0)
        limits.append(tree if not isinstance(tree, tuple) else tree[1])
        lows.append(at)
        highs.append(at)
        if not isinstance(tree, tuple):
            return at, 0
        columns[at] = tree[0]
        (lows[at], a), (highs[at], b) = add(tree[2]), add(tree[3])
        return at, 1 + max(a, b)

    roots, depths = zip(*map(add, forest), strict=True)
    constant = lambda values: F.array(*map(F.lit, values))
    c, limit, low, high = map(constant, (columns, limits, lows, highs))
    numbers = F.array(*map(F.col, names))

    def total(x: Column) -> Column:
        step = lambda node, _: F.when(F.get(x, F.get(c, node)) <= F.get(limit, node), F.get(low, node)).otherwise(F.get(high, node))
        leaf = lambda root: F.aggregate(F.sequence(F.lit(1), F.lit(max(1, *depths))), root, step)
        return F.aggregate(constant(roots), F.lit(0.0), lambda sum_, root: sum_ + F.get(limit, leaf(root)))

    return F.transform(F.array(numbers), total)[0] / float(len(forest))
