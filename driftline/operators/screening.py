"""Screens: ordered reasons, scores and confirmations as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def reasons(checks: list[tuple[str, Column]]) -> Column:
    """The names of the checks that hold, in order; a null check does not."""
    return F.array_compact(F.array(*[F.when(c, F.lit(name)) for name, c in checks]))


def clamp(x: Column) -> Column:
    return F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))


def eligible_symbol(symbol: Column, name: Column, excluded: list[str], pattern: str) -> Column:
    """Not one of the excluded symbols (letters and digits compared in upper case), and no name that matches."""
    return ~F.regexp_replace(F.upper(symbol), "[^A-Z0-9]", "").isin(excluded) & ~name.rlike(pattern)


def eligible_age(created: Column, now: Column, least: int = 10 * 60_000, most: int = 24 * 3_600_000) -> Column:
    """Whether a pool is between the two ages (ms), both included; an unknown age is not."""
    return F.coalesce((now - created).between(least, most), F.lit(False))


def confirmed(rows: DataFrame, keys: list[str], never_less: list[str], never_more: list[str], least: int, most: int) -> Column:
    """Whether a row and the one before it both qualify, `least` to `most` ms apart, with the named columns moving the right way."""
    w = Window.partitionBy(*keys).orderBy("at", "id")
    before = lambda c: F.lag(c).over(w)
    ok = F.col("qualifies") & before("qualifies") & F.col("at").between(before("at") + least, before("at") + most)
    for c in never_less:
        ok = ok & (F.col(c) >= before(c))
    for c in never_more:
        ok = ok & (F.col(c) <= F.coalesce(before(c), F.lit(-1)))
    return F.coalesce(ok, F.lit(False))


def verdict(risks: Column, unknown: Column) -> Column:
    """REJECT with any risk, else UNKNOWN with anything missing, else PASS."""
    return F.when(F.size(risks) > 0, "REJECT").when(F.size(unknown) > 0, "UNKNOWN").otherwise("PASS")


def holder_shares(holders: Column) -> tuple[Column, Column]:
    """Largest and ten largest shares of an array of numbers."""
    top = F.slice(F.sort_array(holders, asc=False), 1, 10)
    return F.coalesce(F.get(top, F.lit(0)), F.lit(0.0)), F.aggregate(top, F.lit(0.0), lambda a, x: a + x)


def round_robin(rows: DataFrame, group: str, order: list[Column], token: str, n: int) -> DataFrame:
    """n rows, one a token, taking the groups' best in turns; group order breaks ties."""
    one = rows.select("*", F.row_number().over(Window.partitionBy(token).orderBy(*order)).alias("__t")).where("__t = 1")
    ranked = one.select("*", F.row_number().over(Window.partitionBy(group).orderBy(*order)).alias("turn")).where(F.col("turn") <= n)
    return ranked.orderBy("turn", group).limit(n).drop("__t")


def trade_plan(lower: Column, price: Column) -> dict[str, Column]:
    """stop, entry_min, entry_max, target and risk percent of a setup."""
    stop = lower * 0.995
    return {"stop": stop, "entry_min": F.greatest(lower, price * 0.99), "entry_max": F.least(price * 1.02, stop / 0.9), "target": price * 2, "risk_pct": (1 - stop / price) * 100}
