"""Monte-Carlo over pools of observed returns, seeded per simulation so that a task that runs again repeats itself."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Simulations a task runs at once.
AT_ONCE = 250


def spread(pools: DataFrame, sims: int) -> DataFrame:
    """Each pool with the first of every AT_ONCE simulations."""
    return pools.select("*", F.explode(F.sequence(F.lit(0), F.lit(sims - 1), F.lit(AT_ONCE))).alias("first")).repartition("key", "first")


def bankroll(pools: DataFrame, fractions: list[float], trades: int, sims: int, seed: int = 1, ruin: float = 0.5) -> DataFrame:
    """key, fraction, sim, end, drawdown, ruined of fixed-fraction betting on draws from a key's `returns` (percent).

    pools: key (string), returns (array of doubles, a bounded summary such as daily means). Fractions of a sim share its draws.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for key, returns, first in zip(pdf["key"], pdf["returns"], pdf["first"], strict=True):
                pool = np.asarray(returns, float) / 100
                rows = []
                for sim in range(first, min(first + AT_ONCE, sims)) if len(pool) else ():
                    draws = np.random.default_rng([seed, sim]).choice(pool, trades)
                    for f in fractions:
                        path = np.concatenate([[1.0], np.cumprod(np.maximum(0.0, 1 + f * draws))])
                        rows.append((key, f, sim, float(path[-1]), float((1 - path / np.maximum.accumulate(path)).max()), bool(path.min() <= ruin)))
                yield pd.DataFrame(rows, columns=["key", "fraction", "sim", "end", "drawdown", "ruined"])

    return spread(pools, sims).mapInPandas(run, "key string, fraction double, sim long, end double, drawdown double, ruined boolean")


def power(bases: DataFrame, effects: list[float], n: int, sims: int, seed: int = 2) -> DataFrame:
    """key, effect, sim, significant: whether the Wilson interval of a simulated rate lies above the key's base rate. bases: key (string), base (double)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        z = 1.959963984540054
        for pdf in batches:
            for key, base, first in zip(pdf["key"], pdf["base"], pdf["first"], strict=True):
                rows = []
                for sim in range(first, min(first + AT_ONCE, sims)):
                    rng = np.random.default_rng([seed, sim])
                    for e in effects:
                        p = rng.binomial(n, min(1.0, base + e)) / n
                        centre, half = p + z * z / (2 * n), z * np.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
                        rows.append((key, e, sim, bool((centre - half) / (1 + z * z / n) > base)))
                yield pd.DataFrame(rows, columns=["key", "effect", "sim", "significant"])

    return spread(bases, sims).mapInPandas(run, "key string, effect double, sim long, significant boolean")
