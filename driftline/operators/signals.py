"""Signals of many variants over one pass of a key's bars, and what comes first after each: stop, target, both in one bar, or neither.

A variant's thresholds are data. All variants share a bar's averages, pivots and zones; what each
keeps of its own is an armed zone or the time of its last signal. Memory is the look-back's,
whatever the length of a key, and the same fold runs over a stream of bars.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from itertools import product
from statistics import fmean

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftline.operators.folds import Fold, folded
from driftline.operators.joins import range_join
from driftline.operators.timeseries import ema, ordered, volume_ratio

#: Fixed values, in bars and fractions.
LOOK_BACK, SIDE, DELAY, APART, NEAR, EXPIRE, MEAN, SLOW, STOP = 288, 3, 12, 6, 0.04, 72, 20, 50, 0.995
ZONE_FROM, TREND_FROM, DIPS, DIP, RECLAIM, MOST_ABOVE, LEAST_RISK, COOLDOWN = 79, 55, 8, 1.01, 1.005, 0.06, 0.015, 72


@dataclass(frozen=True)
class Zone:
    """A reclaimed support zone: armed when a bar below `pullback` times the peak touches it, fired by a strong bar, over after 72 bars or two closes below.

    `falling` arms only while the average of 21 is below that of 50; `strict` excludes equality
    from what the close and the fast average must pass.
    """

    volume: float
    most_risk: float = 0.08
    pullback: float = 0.94
    falling: bool = False
    middle: bool = False
    strict: bool = False
    reach: float = 1.05
    close_position: float = 0.0
    ema_ratio: float = 0.0
    above_sma: bool = False


@dataclass(frozen=True)
class Trend:
    """A pullback within a rising trend that closes above the high before it; the next signal of a variant is 72 bars later at least."""

    volume: float
    most_risk: float
    ordered: bool = False


Variant = Zone | Trend

#: The live pattern (fixed values): a bar that rejects support within a pullback.
SUPPORT = Zone(1.2, 0.08, 0.96, middle=True, close_position=0.65, ema_ratio=0.985)

#: The three families of the studies (fixed values) and the targets of each.
RECLAIM_FAMILY = [Zone(v, falling=True, strict=True, reach=1.03, ema_ratio=e, above_sma=s) for v, e, s in product((1.25, 1.5, 2.0), (0.0, 1.0), (False, True))]
TREND_FAMILY = [Trend(v, r, o) for v, r, o in product((1.0, 1.25, 1.5), (0.05, 0.06, 0.08), (False, True))]
EAGER_FAMILY = [Zone(v, r, p, middle=m, close_position=0.65, ema_ratio=e, above_sma=s) for m, p, v, e, s, r in product((True, False), (0.94, 0.96), (1.0, 1.2, 1.5), (0.985, 1.0), (False, True), (0.08, 0.1))]
FAMILIES = {"reclaim": (RECLAIM_FAMILY, (0.05, 0.08, 0.1)), "trend": (TREND_FAMILY, (0.08, 0.1, 0.12)), "eager": (EAGER_FAMILY, (0.05,))}


class Signals(Fold):
    """Signals of each variant at the close of a bar. A bar that does not follow the one before by `width` ms starts anew.

    Out: variant (its place in the list), at (the bar's close time), entry, stop, risk, ratio (volume over the mean of
    20 bars before), and of a zone: anchor (its pivot's bar), lower, upper, tests (pivots at its level), age (bars since it was
    armed), below (closes below it in a row); fired. With `every`, bars at which a zone is armed and does not fire come out too.
    A bar with a null, or with a price that is not positive, is a hole.
    """

    rows = "open double, high double, low double, close double, volume double"
    state = (
        "n long, at long, fast double, slow array<double>, closes array<double>, volumes array<double>, highs array<double>, lows array<double>, dips array<boolean>, pivots array<long>, pivot_lows array<double>, "
        "armed array<boolean>, lower array<double>, upper array<double>, since array<long>, below array<long>, anchor array<long>, tests array<int>"
    )
    output = "variant int, at long, entry double, stop double, risk double, ratio double, anchor long, lower double, upper double, tests int, age int, below int, fired boolean"

    def __init__(self, variants: Sequence[Variant], width: int, every: bool = False):
        self.variants, self.width, self.every = list(variants), width, every

    def step(self, state, row):
        o, h, low, c, v = (row[k] for k in ("open", "high", "low", "close", "volume"))
        if None in (o, h, low, c, v) or min(o, h, low, c) <= 0:
            return None, []
        at, many = row["at"], len(self.variants)
        if state is None or at - state[1] != self.width:
            state = (-1, at, None, *([] for _ in range(8)), [False] * many, [0.0] * many, [0.0] * many, [0] * many, [0] * many, [0] * many, [0] * many)
        n, _, fast_before, slow, closes, volumes, highs, lows, dips, pivots, pivot_lows, *zones = state
        armed, lower, upper, since, below, anchor, tests = (list(x) for x in zones)
        n += 1
        fast = c if fast_before is None else 0.2 * c + 0.8 * fast_before
        slow = [*slow[-3:], c if not slow else c * (2 / 22) + slow[-1] * (20 / 22)]
        kept, lows = [*closes[1 - SLOW :], c], [*lows[-2 * SIDE :], low]
        if len(lows) == 2 * SIDE + 1 and all(x > lows[SIDE] for k, x in enumerate(lows) if k != SIDE):
            pivots, pivot_lows = [*pivots, n - SIDE], [*pivot_lows, lows[SIDE]]
        while pivots and pivots[0] < n - LOOK_BACK:
            pivots, pivot_lows = pivots[1:], pivot_lows[1:]

        out: list[tuple] = []
        mean = fmean(volumes) if len(volumes) == MEAN else 0.0
        ratio = v / mean if mean > 0 else 0.0
        sma = fmean(kept) if len(kept) == SLOW else None
        place = (c - low) / (h - low) if h > low else 0.0
        rising = fast_before is not None and c > fast > fast_before
        peak, found = max(highs, default=0.0), None

        floor = min(lows[-5:]) * STOP
        steady = n >= TREND_FROM and c > sma and fast > slow[-1] > slow[0] and c > o and place >= 0.65 and mean > 0 and any(dips) and closes[-1] <= RECLAIM * fast_before and c > fast and c > highs[-1] and c / slow[-1] - 1 <= MOST_ABOVE
        for k, x in enumerate(self.variants):
            if isinstance(x, Trend):
                risk = 1 - floor / c
                if steady and ratio >= x.volume and LEAST_RISK <= risk <= x.most_risk and (not x.ordered or slow[-1] > sma) and (not armed[k] or n - since[k] >= COOLDOWN):
                    armed[k], since[k] = True, n
                    out.append((k, at + self.width, c, floor, risk, ratio, None, None, None, None, None, None, True))
                continue
            if n < ZONE_FROM:
                continue
            if armed[k]:
                below[k] = below[k] + 1 if c < lower[k] else 0
                armed[k] = n - since[k] <= EXPIRE and below[k] < 2
            if not armed[k] and c < peak * x.pullback and (not x.falling or slow[-1] < sma):
                found = self.touched(pivots, pivot_lows, n, h, low, c) if found is None else found
                if found:
                    armed[k], since[k], below[k] = True, n, 0
                    pivot, lower[k], upper[k], tests[k] = found
                    anchor[k] = at - (n - pivot) * self.width
            if not armed[k]:
                continue
            pass_close, pass_slow = (lower[k] + upper[k]) / 2 if x.middle else upper[k], x.ema_ratio * slow[-1]
            stop = lower[k] * STOP
            over = c > pass_close and fast > pass_slow if x.strict else c >= pass_close and fast >= pass_slow
            strong = rising and c > o and ratio >= x.volume and place >= x.close_position and (c > sma or not x.above_sma)
            fired = strong and over and c <= upper[k] * x.reach and 1 - stop / c <= x.most_risk
            if fired or self.every:
                out.append((k, at + self.width, c, stop, 1 - stop / c, ratio, anchor[k], lower[k], upper[k], tests[k], n - since[k], below[k], fired))
            armed[k] = not fired

        dips = [*dips[1 - DIPS :], low <= slow[-1] * DIP]
        return (n, at, fast, slow, kept, [*volumes[1 - MEAN :], v], [*highs[1 - LOOK_BACK :], h], lows, dips, pivots, pivot_lows, armed, lower, upper, since, below, anchor, tests), out

    def touched(self, pivots: list[int], lows: list[float], n: int, h: float, low: float, c: float) -> tuple[int, float, float, int] | tuple[()]:
        """Pivot, lower, upper and tests of the zone of the newest pivot with peers that the bar touches and closes in or above; empty if none."""
        old = [(p, x) for p, x in zip(pivots, lows, strict=True) if p <= n - DELAY]
        for p, x in reversed(old):
            peers = [y for q, y in old if abs(q - p) >= APART and abs(y / x - 1) <= NEAR]
            if peers:
                level = (x + peers[-1]) / 2
                if low <= level * 1.035 and h >= level * 0.975 and c >= level * 0.975:
                    return p, level * 0.975, level * 1.035, len(peers) + 1
        return ()


def find(bars: DataFrame, keys: list[str], variants: Sequence[Variant], width: int, every: bool = False) -> DataFrame:
    """keys and `Signals.output` of each signal of each variant: bars cross one exchange, once for all variants."""
    return folded(bars.withColumn("id", F.col("at")), keys, Signals(variants, width, every))


def conditions(bars: DataFrame, armed: DataFrame, keys: list[str], width: int, x: Zone = SUPPORT) -> DataFrame:
    """What each armed bar of one zone variant meets: the eight conditions of its signal, `holds` (all of them) and `fired`, from windows over the bars and the zone of `armed` (`find` with `every`)."""
    grown = ema(bars, keys, {"ema9": 9, "ema21": 21})
    span, close = F.col("high") - F.col("low"), F.col("close")
    seen = grown.select(
        *keys, (F.col("at") + width).alias("at"), "close", "ema9", "ema21", (close > F.col("open")).alias("green"), F.coalesce(volume_ratio(keys) >= x.volume, F.lit(False)).alias("volume"),
        F.when(span > 0, (close - F.col("low")) / span >= x.close_position).otherwise(F.lit(False)).alias("strong_close"), (close > F.col("ema9")).alias("above_ema9"), (F.col("ema9") > F.lag("ema9").over(ordered(keys))).alias("ema9_rising"),
        (F.col("ema9") >= F.col("ema21") * x.ema_ratio).alias("ema_alignment"),
    )
    met = armed.drop("entry").join(seen, [*keys, "at"])
    bound = (F.col("lower") + F.col("upper")) / 2 if x.middle else F.col("upper")
    met = met.withColumns({"close_in_zone": close.between(bound, F.col("upper") * x.reach), "low_risk": F.col("risk") <= x.most_risk})
    names = ["green", "close_in_zone", "volume", "strong_close", "above_ema9", "ema9_rising", "ema_alignment", "low_risk"]
    return met.select(*keys, "at", "anchor", "tests", "age", "below", "risk", *names, reduce(lambda a, b: a & b, map(F.col, names)).alias("holds"), "fired")


def outcomes(signals: DataFrame, bars: DataFrame, keys: list[str], targets: Sequence[float], length: int) -> DataFrame:
    """Each signal with each target (a share of the entry): which of the bars that begin within `length` ms of it came first.

    Adds target, result (stop, target, ambiguous if one bar holds both, else open), hit_at (that
    bar's start) and return_pct (an open signal's, at its last bar). Signals without a bar after them are left out.
    Variants that fire together with one stop meet the bars once. A null key has no bars after it.
    """
    alike = signals.groupBy(*keys, "at", "entry", "stop", "risk", "ratio").agg(F.collect_set("variant").alias("variants"))
    after = range_join(alike, bars.select(*keys, "at", "high", "low", "close"), keys, length)
    first = lambda c: F.min(F.when(c, F.col("r.at")))
    reached = F.array(*[F.struct(F.lit(float(t)).alias("target"), first(F.col("r.high") >= F.col("entry") * (1 + float(t))).alias("at")) for t in targets])
    met = after.groupBy(*alike.columns).agg(first(F.col("r.low") <= F.col("stop")).alias("__stop"), reached.alias("__reached"), F.max_by("r.close", "r.at").alias("__last"))
    each = met.select(*[c for c in alike.columns if c != "variants"], F.explode("variants").alias("variant"), "__stop", "__reached", "__last")
    each = each.select("*", F.explode("__reached").alias("__t"))
    s, t = F.col("__stop"), F.col("__t.at")
    result = F.when(s.isNull() & t.isNull(), "open").when(s == t, "ambiguous").when(t.isNull() | (s < t), "stop").otherwise("target")
    named = each.select(*keys, "variant", "at", "entry", "stop", "risk", "ratio", F.col("__t.target").alias("target"), result.alias("result"), F.least(s, t).alias("hit_at"), "__last")
    return named.withColumn("return_pct", F.when(F.col("result") == "open", (F.col("__last") / F.col("entry") - 1) * 100)).drop("__last")


def counts(results: DataFrame) -> DataFrame:
    """variant, target, and how many signals ended in each way."""
    of = lambda r: F.count_if(F.col("result") == r).alias(r + "s")
    return results.groupBy("variant", "target").agg(F.count(F.lit(1)).alias("signals"), of("target"), of("stop"), F.count_if(F.col("result") == "ambiguous").alias("ambiguous"), F.count_if(F.col("result") == "open").alias("open"))
