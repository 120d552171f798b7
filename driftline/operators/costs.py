"""Execution costs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Liquidity bucket edges and names (fixed values), left-closed.
EDGES = [50_000, 100_000, 250_000, 1_000_000]
NAMES = ["<50k", "50k-<100k", "100k-<250k", "250k-<1m", ">=1m"]


def liquidity_bucket(liquidity: Column) -> Column:
    out = F.when(liquidity < EDGES[0], NAMES[0])
    for edge, name in zip(EDGES[1:], NAMES[1:-1], strict=True):
        out = out.when(liquidity < edge, name)
    return out.otherwise(NAMES[-1])


def observed_bps(fill: Column, quote: Column, fee: Column, size: Column) -> Column:
    """Slippage against the quote and fees, in basis points, at least 0."""
    return F.greatest(F.lit(0.0), (fill / quote - 1) * 10_000 + fee / size * 10_000)


def modelled_bps(size: Column, entry: Column, exit_: Column, fee_bps_side: Column, network: Column) -> Column:
    """1.5 times the size over half the liquidity on both sides, fees of both sides and network costs; at least 100, null on bad input."""
    impact = 1.5 * (size / (entry / 2) + size / (exit_ / 2)) * 10_000
    good = (size > 0) & (entry > 0) & (exit_ > 0)
    return F.when(good, F.greatest(F.lit(100.0), impact + 2 * fee_bps_side + network / size * 10_000))
