"""Many weighted logistic regressions at once: a Newton step of all of them is one pass over the rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows times fits that a task works on at once; a step holds some ten arrays of as many doubles.
CELLS = 250_000
Weigh = Callable[[pa.RecordBatch], np.ndarray]


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


@dataclass
class Fits:
    """beta: coefficients of scaled features, the intercept last; slope and intercept: of plain features; n and positive: sums of weights."""

    beta: np.ndarray
    slope: np.ndarray
    intercept: np.ndarray
    n: np.ndarray
    positive: np.ndarray

    @property
    def usable(self) -> np.ndarray:
        """Fits that saw both classes."""
        return (self.positive > 0) & (self.positive < self.n)

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        """(rows, fits)."""
        return sigmoid(x @ self.slope.T + self.intercept)


def matrix(batch: pa.RecordBatch, features: list[str]) -> np.ndarray:
    return np.stack([batch.column(f).to_numpy(zero_copy_only=False) for f in features], 1).astype(np.float64)


def summed(rows: DataFrame, features: list[str], weigh: Weigh, fits: int, size: int, work: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
    """Sums over all rows of work(x, y, weights), an array (fits, size); a row a fit reaches the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, step = np.zeros((fits, size)), max(1, CELLS // fits)
        for whole in batches:
            for a in range(0, whole.num_rows, step):
                batch = whole.slice(a, step)
                out += work(matrix(batch, features), batch.column("y").to_numpy(zero_copy_only=False), weigh(batch))
        yield pa.RecordBatch.from_arrays([pa.array(range(fits), pa.int32()), pa.array(list(out), pa.list_(pa.float64()))], names=["fit", "sums"])

    parts = rows.mapInArrow(run, "fit int, sums array<double>").groupBy("fit").agg(F.array(*[F.sum(F.col("sums")[j]) for j in range(size)]).alias("sums"))
    out = np.zeros((fits, size))
    for r in parts.collect():
        out[r["fit"]] = r["sums"]
    return out


def fit(rows: DataFrame, features: list[str], weigh: Weigh, fits: int, ridge: np.ndarray | float, rounds: int = 25) -> Fits:
    """Logistic regressions of y (0 to 1) on scaled features, each with its own weights of rows and its own ridge penalty.

    `rows` (y and features without nulls) should be a checkpoint or a table, as it is read once a
    round. Every fit scales by its own weighted spread. Fits that saw one class only keep zeros.
    """
    d = len(features)
    sums = summed(rows, features, weigh, fits, 2 + 2 * d, lambda x, y, v: np.concatenate([v.sum(1)[:, None], (v * y).sum(1)[:, None], v @ x, v @ (x * x)], 1))
    n, positive = sums[:, 0], sums[:, 1]
    mean = sums[:, 2 : 2 + d] / np.maximum(n, 1e-300)[:, None]
    spread = np.sqrt(np.maximum(sums[:, 2 + d :] / np.maximum(n, 1e-300)[:, None] - mean**2, 0))
    spread = np.where(spread > 1e-9 * (1 + np.abs(mean)), spread, 1.0)
    penalty = np.concatenate([np.broadcast_to(np.reshape(ridge, (-1, 1)), (fits, d)), np.full((fits, 1), 1e-9)], 1)
    # from plain features to scaled ones
    t = np.zeros((fits, d + 1, d + 1))
    t[:, np.arange(d), np.arange(d)] = 1 / spread
    t[:, d, :d], t[:, d, d] = -mean / spread, 1
    live = ((positive > 0) & (positive < n))[:, None]
    beta = np.zeros((fits, d + 1))
    for _ in range(rounds):
        slope = beta[:, :d] / spread
        intercept = beta[:, d] - (slope * mean).sum(1)

        def newton(x: np.ndarray, y: np.ndarray, v: np.ndarray, slope: np.ndarray = slope, intercept: np.ndarray = intercept) -> np.ndarray:
            p = sigmoid(slope @ x.T + intercept[:, None])
            one = np.concatenate([x, np.ones((len(x), 1))], 1)
            return np.concatenate([(v * (p - y)) @ one, (v * p * (1 - p)) @ (one[:, :, None] * one[:, None, :]).reshape(len(x), -1)], 1)

        got = summed(rows, features, weigh, fits, (d + 1) + (d + 1) ** 2, newton)
        gradient = np.einsum("rij,ri->rj", t, got[:, : d + 1]) + penalty * beta
        hessian = np.einsum("rij,rik,rkl->rjl", t, got[:, d + 1 :].reshape(-1, d + 1, d + 1), t) + penalty[:, :, None] * np.eye(d + 1)
        move = np.where(live, np.linalg.solve(hessian + 1e-12 * np.eye(d + 1), gradient[:, :, None])[:, :, 0], 0)
        beta = beta - np.clip(move, -5, 5)  # steps of separable data would run away
        if np.abs(move).max() < 1e-9:
            break
    slope = beta[:, :d] / spread
    return Fits(beta, slope, beta[:, d] - (slope * mean).sum(1), n, positive)
