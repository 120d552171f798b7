"""Bars and causal indicators. Keys are column names; bars have at (ms, bar start), open, high, low, close, volume.

Every indicator is a window over one key's bars, so a plan has one exchange and one sort by
(key, at), which consecutive indicators share.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def ordered(keys: list[str]) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy("at")


def candles(trades: DataFrame, keys: list[str], width: int) -> DataFrame:
    """Bars of `width` ms: first and last price by (at, id), extremes, exact volume, number of trades. Partial aggregates before the exchange."""
    start = (F.expr(f"at div {width}") * width).alias("at")
    order = F.struct("at", "id")
    return trades.groupBy(*keys, start).agg(
        F.min_by("price", order).alias("open"),
        F.max("price").alias("high"),
        F.min("price").alias("low"),
        F.max_by("price", order).alias("close"),
        F.sum(F.col("usd").cast("decimal(18,2)")).cast("double").alias("volume"),
        F.count(F.lit(1)).alias("trades"),
    )


def tick_bars(trades: DataFrame, keys: list[str], each: int, width: int) -> DataFrame:
    """Bars of `each` consecutive trades by (at, id), the n-th said to begin at n * `width` ms; an unfinished last one is left out."""
    n = F.row_number().over(Window.partitionBy(*keys).orderBy("at", "id")) - 1
    numbered = trades.select(*keys, "id", "at", "price", "usd", n.alias("__n")).withColumn("__b", F.expr(f"__n div {each}"))
    g = numbered.groupBy(*keys, "__b").agg(
        F.min_by("price", "__n").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", "__n").alias("close"), F.sum(F.col("usd").cast("decimal(18,2)")).cast("double").alias("volume"), F.count(F.lit(1)).alias("trades")
    )
    return g.where(F.col("trades") == each).select(*keys, (F.col("__b") * width).alias("at"), "open", "high", "low", "close", "volume", "trades")


def valid_bars(bars: DataFrame, width: int, now: int, conflicts: str = "drop") -> DataFrame:
    """Aligned, closed, consistent bars; equal bars of one time become one.

    Different bars of one time are in conflict: with "drop" their time is left out, with "flag" they
    stay and are told by a column `conflict`, with "raise" reading them ends with an error.
    """
    if conflicts not in ("drop", "flag", "raise"):
        raise ValueError("conflicts must be drop, flag or raise")
    good = (F.col("at") % width == 0) & (F.col("low") > 0) & (F.col("low") <= F.least("open", "close")) & (F.col("high") >= F.greatest("open", "close")) & (F.col("volume") >= 0)
    closed = bars.where((F.col("at") + width <= now) & good).distinct()
    others = [c for c in bars.columns if c != "at"]
    keys = [c for c in others if c not in ("open", "high", "low", "close", "volume", "trades")]
    counted = closed.select("*", (F.count(F.lit(1)).over(Window.partitionBy(*keys, "at")) > 1).alias("conflict"))
    if conflicts == "flag":
        return counted
    fine = ~F.col("conflict") if conflicts == "drop" else F.when(F.col("conflict"), F.raise_error(F.lit("conflicting bars of one time")).cast("boolean")).otherwise(F.lit(True))
    return counted.where(fine).drop("conflict")


def contiguous_tail(bars: DataFrame, keys: list[str], width: int) -> DataFrame:
    """The newest run of bars without a hole: those whose distance to the newest equals their rank from it."""
    back = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("at").desc())) - 1
    newest = F.max("at").over(Window.partitionBy(*keys))
    return bars.select("*", back.alias("__back"), newest.alias("__newest")).where(F.col("at") == F.col("__newest") - F.col("__back").cast("long") * width).drop("__back", "__newest")


def framed(function, column: str, keys: list[str], first: int, last: int) -> Column:
    return function(column).over(ordered(keys).rowsBetween(first, last))


def full(keys: list[str], n: int) -> Column:
    """Whether a bar has n - 1 bars before it."""
    return F.row_number().over(ordered(keys)) >= n


def sma(column: str, keys: list[str], n: int) -> Column:
    return F.when(full(keys, n), framed(F.avg, column, keys, -(n - 1), 0))


def volume_ratio(keys: list[str], n: int = 20) -> Column:
    """Volume over the mean of the n bars before it, null before there are n or when they are empty."""
    mean = framed(F.avg, "volume", keys, -n, -1)
    return F.when(full(keys, n + 1) & (mean > 0), F.col("volume") / mean)


def true_range(keys: list[str]) -> Column:
    before = F.lag("close").over(ordered(keys))
    return F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before))


def atr(bars: DataFrame, keys: list[str], n: int = 14) -> DataFrame:
    """Adds atr: the plain mean of n true ranges, null before there are n with a bar before them."""
    ranged = bars.select("*", true_range(keys).alias("true_range"))
    return ranged.select("*", F.when(full(keys, n + 1), framed(F.avg, "true_range", keys, -(n - 1), 0)).alias("atr"))


def prior_peak(keys: list[str], n: int = 288) -> Column:
    return framed(F.max, "high", keys, -n, -1)


def drawdown(keys: list[str], n: int = 288) -> Column:
    peak = prior_peak(keys, n)
    return F.when(peak > 0, (peak - F.col("close")) / peak * 100)


def ema(bars: DataFrame, keys: list[str], spans: dict[str, int], seeded: bool = False) -> DataFrame:
    """Adds an exponential average for each name: from the first close, or (`seeded`) from the mean of the first `span` closes.

    The recursion is inherently serial within a key, so keys are Arrow batches of their own.
    """
    schema = ", ".join([f"{f.name} {f.dataType.simpleString()}" for f in bars.schema] + [f"{name} double" for name in spans])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("at", ignore_index=True)
        for name, span in spans.items():
            close = pdf["close"].copy()
            if seeded:
                if len(close) >= span:
                    close.iloc[span - 1] = close.iloc[:span].mean()
                close.iloc[: span - 1] = None
            pdf[name] = close.ewm(span=span, adjust=False, ignore_na=True).mean()
        return pdf

    return bars.groupBy(*keys).applyInPandas(run, schema)


def slope(column: str, keys: list[str], n: int = 1) -> Column:
    before = F.lag(column, n).over(ordered(keys))
    return F.when(before != 0, (F.col(column) - before) / before * 100)


def body_features(bars: DataFrame) -> DataFrame:
    """Adds body, wicks and close position as percentages of the bar's range (0 for a flat bar)."""
    span = F.col("high") - F.col("low")
    share = lambda x: F.when(span > 0, x / span * 100).otherwise(0.0)
    return bars.select(
        "*",
        share(F.abs(F.col("close") - F.col("open"))).alias("body_pct"),
        share(F.col("high") - F.greatest("open", "close")).alias("upper_wick_pct"),
        share(F.least("open", "close") - F.col("low")).alias("lower_wick_pct"),
        share(F.col("close") - F.col("low")).alias("close_position"),
    )


def pivot_lows(keys: list[str], side: int = 3, delay: int = 12) -> Column:
    """Whether a bar's low is strictly below those of `side` bars on each side and `delay` bars have followed."""
    left, right = framed(F.min, "low", keys, -side, -1), framed(F.min, "low", keys, 1, side)
    later = F.count(F.lit(1)).over(ordered(keys).rowsBetween(1, delay))
    return full(keys, side + 1) & (later >= delay) & (F.col("low") < left) & (F.col("low") < right)


def pivot_peers(bars: DataFrame, keys: list[str], near: float = 0.04, apart: int = 0, look_back: int = 288) -> DataFrame:
    """at, low, peers of each pivot: earlier pivots within `look_back` bars, `apart` ms away at least, whose low is within `near`."""
    numbered = bars.select(*keys, "at", "low", F.row_number().over(ordered(keys)).alias("i"), pivot_lows(keys).alias("pivot")).where("pivot").drop("pivot")
    window = ordered(keys).rowsBetween(-look_back, -1)
    listed = numbered.select("*", F.collect_list(F.struct("i", "at", "low")).over(window).alias("before"))
    alike = F.filter("before", lambda p: (p["i"] >= F.col("i") - look_back) & (F.abs(p["low"] / F.col("low") - 1) <= near) & (F.col("at") - p["at"] >= apart))
    return listed.select(*keys, "at", "low", F.size(alike).cast("long").alias("peers"))


def higher_lows(keys: list[str]) -> Column:
    a, b, c = (framed(F.min, "low", keys, -k - 2, -k) for k in (6, 3, 0))
    return F.when(full(keys, 9), (a < b) & (b < c))


def pullback(keys: list[str], n: int = 10) -> Column:
    peak = framed(F.max, "high", keys, -(n - 1), 0)
    return F.when(full(keys, n), (peak - F.col("close")) / peak)


def largest_gap(column: str, keys: list[str]) -> Column:
    return F.col(column) - F.lag(column).over(Window.partitionBy(*keys).orderBy(column))
