"""Forward labels of observations from their paths (id, i, bar, open, high, low, close, entry)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def first_hit(paths: DataFrame, stop: float, target: float, width: int, whole: int) -> DataFrame:
    """stop_at, target_at (bar close times), first (stop, target, ambiguous or null), complete: which side of the entry was reached first; both in one bar is ambiguous."""
    hit = lambda c: F.min(F.when(c, F.col("bar") + width))
    g = paths.groupBy("id").agg(hit(F.col("low") <= F.col("entry") * stop).alias("stop_at"), hit(F.col("high") >= F.col("entry") * target).alias("target_at"), F.count(F.lit(1)).alias("bars"))
    s, t = F.col("stop_at"), F.col("target_at")
    first = F.when(s.isNull() & t.isNull(), F.lit(None).cast("string")).when(s == t, "ambiguous").when(t.isNull() | (s < t), "stop").otherwise("target")
    return g.select("id", "stop_at", "target_at", first.alias("first"), (F.col("bars") >= whole).alias("complete"))


def label(first: Column, resolved: Column, end: Column, complete: Column) -> tuple[Column, Column]:
    """y (1 target, 0 stop, else null) and the time the label was known."""
    y = F.when(first == "target", 1).when(first == "stop", 0)
    return y, F.coalesce(resolved, F.when(complete, end))


def horizon_returns(paths: DataFrame, bars: list[int]) -> DataFrame:
    """id and the percent return at the close of the n-th bar for each n; null where the path is shorter."""
    cols = [F.max(F.when(F.col("i") == n - 1, (F.col("close") / F.col("entry") - 1) * 100)).alias(f"r{n}") for n in bars]
    return paths.groupBy("id").agg(*cols)


def rug_outcome(samples: DataFrame, key: str, floor: float = 100.0, share: float = 0.01) -> DataFrame:
    """Return of the last sample, or a complete -100 % if liquidity ever fell to max(floor, share of the first); excursions from the first price."""
    order = F.struct("at", "id")
    g = samples.groupBy(key).agg(F.min_by("price", order).alias("entry"), F.min_by("liquidity", order).alias("liquidity0"), F.max_by("price", order).alias("last"), F.min("liquidity").alias("least"), F.max("price").alias("high"), F.min("price").alias("low"))
    rug = F.col("least") <= F.greatest(F.lit(floor), F.col("liquidity0") * share)
    return g.select(key, rug.alias("rug"), F.when(rug, F.lit(-100.0)).otherwise((F.col("last") / F.col("entry") - 1) * 100).alias("ret"), ((F.col("high") / F.col("entry") - 1) * 100).alias("mfe"), F.when(rug, F.lit(-100.0)).otherwise((F.col("low") / F.col("entry") - 1) * 100).alias("mae"))
