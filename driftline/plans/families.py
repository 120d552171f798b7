"""Queries over signal families and flow features: bars of four trades of each chain, whose price buys push up and sells push down."""

from __future__ import annotations

from dataclasses import replace
from itertools import product

from pyspark.sql import Window
from pyspark.sql import functions as F

from driftline.operators import flow, signals
from driftline.operators import timeseries as ts
from driftline.plans.registry import Registry
from driftline.plans.views import HOUR, TRADES, trades

reg = Registry()
K = ["chain"]
EACH, WIDTH, LENGTH = 4, 300_000, 24 * HOUR


def pushed(spark, d):
    """Trades at a price that every buy so far has raised by 0.4, 0.8 or 1.2 % and every sell lowered by half as much again."""
    t = trades(spark, d)
    step = (F.col("id") % 3 + 1) * F.when(F.col("side") == "buy", 2).otherwise(-3)
    so_far = F.sum(step).over(Window.partitionBy("chain").orderBy("at", "id").rowsBetween(Window.unboundedPreceding, 0))
    return t.withColumn("price", F.round(100 * F.exp(so_far / 500.0), 6))


def tick_bars(spark, d):
    return ts.tick_bars(pushed(spark, d), K, EACH, WIDTH)


TICKS = f"""{TRADES}, pushed AS (SELECT *, row_number() OVER w - 1 AS n, round(100 * exp(sum((id % 3 + 1) * CASE WHEN side = 'buy' THEN 2 ELSE -3 END) OVER w / 500.0::DOUBLE), 6) AS p FROM trades WINDOW w AS (PARTITION BY chain ORDER BY at, id)),
bars AS (SELECT chain, n // {EACH} AS i, n // {EACH} * {WIDTH} AS at, first(p ORDER BY n) AS open, max(p) AS high, min(p) AS low, last(p ORDER BY n) AS close, sum(usd::DECIMAL(18, 2))::DOUBLE AS volume FROM pushed GROUP BY ALL HAVING count(*) = {EACH})"""
GROWN = f"""{TICKS}, e AS (SELECT chain, i, close AS fast, close AS slow FROM bars WHERE i = 0 UNION ALL SELECT b.chain, b.i, 0.2::DOUBLE * b.close + 0.8::DOUBLE * e.fast, b.close * (2.0::DOUBLE / 22) + e.slow * (20.0::DOUBLE / 22) FROM e JOIN bars b ON b.chain = e.chain AND b.i = e.i + 1),
f AS (SELECT *, lag(close) OVER w AS c1, lag(high) OVER w AS h1, lag(fast) OVER w AS fast1, lag(slow, 3) OVER w AS slow3, avg(close) OVER (w ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS sma, avg(volume) OVER (w ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) AS mean,
  bool_or(low <= slow * 1.01::DOUBLE) OVER (w ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING) AS dipped, min(low) OVER (w ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) * 0.995::DOUBLE AS stop FROM bars JOIN e USING (chain, i) WINDOW w AS (PARTITION BY chain ORDER BY i)),
steady AS (SELECT *, volume / mean AS ratio, 1 - stop / close AS risk FROM f WHERE i >= 55 AND close > sma AND fast > slow AND slow > slow3 AND close > open AND high > low AND (close - low) / (high - low) >= 0.65::DOUBLE AND mean > 0 AND dipped
  AND c1 <= fast1 * 1.005::DOUBLE AND close > fast AND close > h1 AND close / slow - 1 <= 0.06::DOUBLE AND 1 - stop / close >= 0.015::DOUBLE),
variants AS (SELECT * FROM (VALUES {", ".join(f"({k}, {x.volume}::DOUBLE, {x.most_risk}::DOUBLE, {x.ordered})" for k, x in enumerate(signals.TREND_FAMILY))}) v(variant, volume_ratio, most_risk, ordered)),
ready AS (SELECT variant, steady.* FROM steady JOIN variants ON ratio >= volume_ratio AND risk <= most_risk AND (NOT ordered OR slow > sma)),
taken AS (SELECT variant, chain, min(i) AS i FROM ready GROUP BY ALL UNION ALL SELECT t.variant, t.chain, (SELECT min(r.i) FROM ready r WHERE r.variant = t.variant AND r.chain = t.chain AND r.i >= t.i + 72) FROM taken t WHERE t.i IS NOT NULL),
sig AS (SELECT r.variant, r.chain, r.at + {WIDTH} AS at, r.close AS entry, r.stop, r.risk, r.ratio FROM ready r JOIN taken USING (variant, chain, i)),
tg AS (SELECT unnest([{", ".join(f"{t}::DOUBLE" for t in signals.FAMILIES["trend"][1])}]) AS target),
met AS (SELECT s.*, target, min(b.at) FILTER (b.low <= s.stop) AS st, min(b.at) FILTER (b.high >= s.entry * (1 + target)) AS tt, arg_max(b.close, b.at) AS last FROM sig s JOIN bars b ON b.chain = s.chain AND b.at >= s.at AND b.at < s.at + {LENGTH}, tg GROUP BY ALL),
res AS (SELECT *, CASE WHEN st IS NULL AND tt IS NULL THEN 'open' WHEN st = tt THEN 'ambiguous' WHEN tt IS NULL OR st < tt THEN 'stop' ELSE 'target' END AS result FROM met)"""


# ---- the live pattern

@reg.query()
def support_pattern(spark, d):
    """Rejections of support: the zone, its anchor and tests, entry, stop and risk."""
    return signals.find(tick_bars(spark, d), K, [signals.SUPPORT], WIDTH).select("chain", "at", "anchor", "lower", "upper", "tests", "entry", "stop", "risk")


@reg.query()
def support_conditions(spark, d):
    """Each bar with an armed zone, and which of the signal's eight conditions it meets."""
    bars = tick_bars(spark, d)
    return signals.conditions(bars, signals.find(bars, K, [signals.SUPPORT], WIDTH, every=True), K, WIDTH)


SWEEP = [replace(signals.SUPPORT, volume=v, close_position=c, pullback=p) for v, c, p in product((1.0, 1.2, 1.5), (0.5, 0.65), (0.94, 0.96))]


@reg.query()
def pattern_variants_sweep(spark, d):
    """Signals of each combination of thresholds, all run over a key's bars at once."""
    found = signals.find(tick_bars(spark, d), K, SWEEP, WIDTH)
    return found.groupBy("variant", "chain").agg(F.count(F.lit(1)).alias("signals"), F.min("at").alias("since"), F.max("at").alias("until"))


# ---- families

def studied(spark, d, family: str):
    variants, targets = signals.FAMILIES[family]
    bars = tick_bars(spark, d)
    return signals.outcomes(signals.find(bars, K, variants, WIDTH), bars, K, targets, LENGTH)


@reg.query(f"WITH RECURSIVE {GROWN} SELECT variant, chain, at, round(entry, 6) AS entry, round(stop, 6) AS stop, target, result, least(st, tt) AS hit_at, round(CASE WHEN result = 'open' THEN (last / entry - 1) * 100 END, 6) AS return_pct FROM res")
def trend_signals(spark, d):
    """Every signal of the trend family's 18 variants with each target: what came first within a day."""
    r = lambda c: F.round(c, 6).alias(c)
    return studied(spark, d, "trend").select("variant", "chain", "at", r("entry"), r("stop"), "target", "result", "hit_at", r("return_pct"))


def family_counts(spark, d, family: str):
    return signals.counts(studied(spark, d, family)).select(F.lit(family).alias("family"), "*")


@reg.query(f"WITH RECURSIVE {GROWN} SELECT 'trend' AS family, variant, target, count(*) AS signals, count(*) FILTER (result = 'target') AS targets, count(*) FILTER (result = 'stop') AS stops, count(*) FILTER (result = 'ambiguous') AS ambiguous, count(*) FILTER (result = 'open') AS \"open\" FROM res GROUP BY ALL")
def trend_study(spark, d):
    """Outcomes by variant and target of the trend family."""
    return family_counts(spark, d, "trend")


@reg.query()
def reclaim_study(spark, d):
    """Outcomes by variant and target of the early reclaims of support zones."""
    return family_counts(spark, d, "reclaim")


@reg.query()
def eager_study(spark, d):
    """Outcomes by variant of the 96 eager zone variants."""
    return family_counts(spark, d, "eager")


# ---- flow

SNAPSHOTS = "sn AS (SELECT id, at, chain, pool, id * 53 % 70 AS buyers, id * 31 % 40 AS buys, id * 17 % 30 AS sells, CASE WHEN id % 13 > 0 THEN usd * 200 END AS liquidity, usd * 10 AS volume FROM trades), las AS (SELECT chain, pool, at, max_by(sn, id) AS s FROM sn GROUP BY ALL)"
PRIOR = " ".join(f"ASOF LEFT JOIN las l{m} ON l{m}.chain = sn.chain AND l{m}.pool = sn.pool AND sn.at - {m * 60_000} >= l{m}.at" for m in (5, 15, 30, 60))
CHANGES = ", ".join(f"round(CASE WHEN l{m}.s.liquidity > 0 THEN sn.liquidity / l{m}.s.liquidity * 100 - 100 END, 6) AS liquidity_change_{m}m" for m in (15, 30, 60))


@reg.query(f"""WITH {TRADES}, {SNAPSHOTS} SELECT sn.id, round(sn.volume / nullif(sn.liquidity, 0), 6) AS volume_to_liquidity, sn.buyers - l5.s.buyers AS buyer_acceleration,
round(CASE WHEN sn.sells > 0 AND l5.s.sells > 0 THEN sn.buys::DOUBLE / sn.sells - l5.s.buys::DOUBLE / l5.s.sells END, 6) AS count_ratio_trend, {CHANGES} FROM sn {PRIOR}""")
def market_flow_features(spark, d):
    """Six features of each snapshot of a pool's flow, every event being one."""
    t = trades(spark, d)
    i = lambda k, m: F.col("id") * k % m
    snapshots = t.select("id", "at", "chain", "pool", i(53, 70).alias("buyers"), i(31, 40).alias("buys"), i(17, 30).alias("sells"), F.when(F.col("id") % 13 > 0, F.col("usd") * 200).alias("liquidity"), (F.col("usd") * 10).alias("volume"))
    r = lambda c: F.round(c, 6).alias(c)
    return flow.flow_features(snapshots, ["chain", "pool"]).select("id", r("volume_to_liquidity"), "buyer_acceleration", r("count_ratio_trend"), *[r(f"liquidity_change_{m}m") for m in (15, 30, 60)])
