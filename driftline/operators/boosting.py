"""Boosted trees over few rows with weights: what MLlib's GBTClassifier fits to them, without two jobs for each level of each tree."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Trees:
    """Nodes of all trees, (trees, nodes), node i's children being 2 i + 1 and 2 i + 2; feature -1: a leaf. Rows up to a cut go left."""

    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray

    def margin(self, x: np.ndarray) -> np.ndarray:
        out, depth = np.zeros(len(x)), int(np.log2(self.value.shape[1] + 1)) - 1
        every = np.arange(len(x))
        for feature, cut, value in zip(self.feature, self.cut, self.value, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(depth):
                f = feature[node]
                node = np.where(f < 0, node, 2 * node + 1 + (x[every, f] > cut[node]))
            out += value[node]
        return out

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-2 * self.margin(x)))


def cuts(values: np.ndarray, weights: np.ndarray, most: int) -> np.ndarray:
    """At most `most` thresholds between different values: all, or those nearest to equal shares of the weight, each looked for after the one before."""
    different, place = np.unique(values, return_inverse=True)
    middles = (different[:-1] + different[1:]) / 2
    if len(middles) <= most:
        return middles
    reached = np.cumsum(np.bincount(place, weights))
    step = reached[-1] / (most + 1)
    found, wanted = [], step
    for i in range(len(middles)):
        if abs(reached[i] - wanted) < abs(reached[i + 1] - wanted):
            found.append(middles[i])
            wanted += step
    return np.array(found)


def grow(trees: Trees, t: int, node: int, rows: np.ndarray, bins: list[np.ndarray], at: list[np.ndarray], target: np.ndarray, w: np.ndarray, ends: np.ndarray) -> None:
    """Splits a node where that lessens the variance most, down to the last level; ends: the node that each row ends in."""
    n, s = w[rows].sum(), (w[rows] * target[rows]).sum()
    trees.value[t, node], ends[rows] = s / n, node
    if 2 * node + 2 >= trees.value.shape[1]:
        return
    best = (1e-24 * (w[rows] * target[rows] ** 2).sum(), -1, -1)  # less is rounding
    for f, c in enumerate(at):
        if not len(c):
            continue
        left_n, left_s = (np.cumsum(np.bincount(bins[f][rows], v, len(c) + 1))[:-1] for v in (w[rows], w[rows] * target[rows]))
        seen = np.cumsum(np.bincount(bins[f][rows], minlength=len(c) + 1))[:-1]
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = np.where((seen > 0) & (seen < len(rows)), left_n * (n - left_n) / n * (left_s / left_n - (s - left_s) / (n - left_n)) ** 2, 0)
        j = int(np.argmax(gain))
        if gain[j] > best[0]:
            best = (gain[j], f, j)
    _, f, j = best
    if f < 0:
        return
    trees.feature[t, node], trees.cut[t, node] = f, at[f][j]
    low = bins[f][rows] <= j
    for child, part in ((2 * node + 1, rows[low]), (2 * node + 2, rows[~low])):
        grow(trees, t, child, part, bins, at, target, w, ends)


def fit(x: np.ndarray, y: np.ndarray, w: np.ndarray, rounds: int, rate: float, depth: int, most_bins: int) -> Trees:
    """Trees on the gradient of the logistic loss of y (0 or 1), each but the first scaled by the rate; x without missing values."""
    at = [cuts(v, w, min(most_bins, len(w)) - 1) for v in x.T]
    bins = [np.searchsorted(c, v) for c, v in zip(at, x.T, strict=True)]
    shape = (rounds, 2 ** (depth + 1) - 1)
    trees = Trees(np.full(shape, -1), np.zeros(shape), np.zeros(shape))
    sign, said, every, ends = 2.0 * y - 1, np.zeros(len(w)), np.arange(len(w)), np.zeros(len(w), np.int64)
    for t in range(rounds):
        target = 4 * sign / (1 + np.exp(2 * sign * said)) if t else sign
        grow(trees, t, 0, every, bins, at, target, w, ends)
        trees.value[t] *= rate if t else 1
        said += trees.value[t, ends]
    return trees
