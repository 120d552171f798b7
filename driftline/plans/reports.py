"""Queries over gates, screens, stored state, outcome reports and orders."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from driftline.operators import gates, joins, ledger, normalize, resample, rollout, screening
from driftline.operators import timeseries as ts
from driftline.plans.registry import Registry
from driftline.plans.studies import DAY, PAIRS, ORD, order_rows, paired_days, r6
from driftline.plans.views import BARS, FILLS, HOUR, TRADES, bars, fills, table, trades
from driftline.session import shared_folder
from driftline.sources import sinks, tables

reg = Registry()
K, R = ["chain"], ["rule"]

# ---- gates and screens: a part stands for a candidate

NUMBERS = {
    "age_minutes": "p_partkey * 13 % 2000", "liquidity": "p_partkey * 7919 % 200000", "volume": "p_partkey * 104729 % 40000", "buys": "p_partkey * 31 % 90", "sells": "p_partkey * 17 % 60", "buyers": "p_partkey * 53 % 70",
    "price_change": "p_partkey * 11 % 40", "fdv": "p_partkey * 15485863 % 4000000", "top1": "p_partkey * 3 % 40", "top5": "p_partkey * 7 % 100", "usd_ratio": "p_partkey * 19 % 40", "previous": "p_partkey * 23 % 30000", "preceding": "p_partkey * 29 % 20000", "minute_share": "p_partkey * 41 % 70",
}
CANDIDATES = "cand AS (SELECT p_partkey, " + ", ".join(f"({v})::BIGINT AS {k}" for k, v in NUMBERS.items()) + ", p_size % 5 = 0 AS unpriced, p_size % 7 = 0 AS uncounted, p_size % 3 = 0 AS unmatched, p_size % 11 = 0 AS uncovered, p_size % 13 = 0 AS untradeable FROM part)"


def candidates(spark, d):
    flags = {"unpriced": 5, "uncounted": 7, "unmatched": 3, "uncovered": 11, "untradeable": 13}
    return table(spark, d, "part").select("p_partkey", *[F.expr(f"cast({v} AS BIGINT)").alias(k) for k, v in NUMBERS.items()], *[(F.col("p_size") % m == 0).alias(k) for k, m in flags.items()])


def checks_sql(checks: list[tuple[str, str]]) -> str:
    return "list_filter([" + ", ".join(f"CASE WHEN {c} THEN '{n}' END" for n, c in checks) + "], lambda x: x IS NOT NULL)"


@reg.query(f"WITH {CANDIDATES}, r AS (SELECT p_partkey, {checks_sql(gates.MARKET)} AS reasons FROM cand) SELECT p_partkey, array_to_string(reasons, ',') AS reasons, len(reasons) = 0 AS passed, -len(reasons)::INT AS priority FROM r")
def market_screen_full(spark, d):
    """All thirteen reasons of the market screen, in order."""
    r = candidates(spark, d).select("p_partkey", gates.failed(gates.MARKET).alias("r"))
    return r.select("p_partkey", F.array_join("r", ",").alias("reasons"), (F.size("r") == 0).alias("passed"), (-F.size("r")).alias("priority"))


# Numbers of a candidate's snapshot, in SQL that both engines read.
real = lambda k, m, by, plus=0: f"(CAST({plus} AS DOUBLE) + CAST(p_partkey * {k} % {m} AS DOUBLE) / {by})"
NOW = 1_700_000_000_000
LIQUIDITY, QUOTED = "(40000 + CAST(p_partkey * 7919 % 300000 AS DOUBLE))", f"(CASE WHEN p_partkey % 41 = 0 THEN CAST(0 AS DOUBLE) ELSE {real(11, 50, 10, 1)} END)"
SNAPSHOT = {
    "at": str(NOW), "covered": "p_partkey % 19 <> 0", "tradeable": "p_partkey % 17 <> 0", "security": "CASE WHEN p_partkey % 23 = 0 THEN 'REJECT' WHEN p_partkey % 29 = 0 THEN 'UNKNOWN' ELSE 'PASS' END",
    "security_reasons": "CASE WHEN p_partkey % 23 = 0 THEN 'honeypot' WHEN p_partkey % 29 = 0 THEN 'holders, creator' END", "checked_at": f"{NOW} - (p_partkey * 37 % 64 - 1) * 1000", "market": "p_partkey % 31 <> 0", "matches": "p_partkey % 37 <> 0",
    "created_at": f"{NOW} - p_partkey * 13 % 1500 * 60000", "fetched_at": f"{NOW} - (p_partkey * 43 % 65 - 1) * 1000", "pool": "CAST(p_partkey % 9 AS VARCHAR(9))", "liquidity": LIQUIDITY, "min_liquidity": "50000", "fdv": "CAST(p_partkey * 15487 % 3000000 AS DOUBLE)",
    "price": QUOTED, "price_change": "CAST(p_partkey * 11 % 30 - 2 AS DOUBLE)", "volume": "8000 + CAST(p_partkey * 104729 % 60000 AS DOUBLE)", "buys": "20 + p_partkey * 31 % 90", "sells": "p_partkey * 17 % 30", "buyers": "15 + p_partkey * 53 % 120",
    "usd_ratio": real(19, 40, 20, 1.2), "top_buyer": real(3, 22, 100), "top_five": real(7, 65, 100), "previous_volume": "CAST(p_partkey * 23 % 30000 AS DOUBLE)", "preceding_volume": "CAST(p_partkey * 29 % 20000 AS DOUBLE)", "minute_share": real(41, 70, 100),
    "flow_change": "CASE WHEN p_partkey % 3 > 0 THEN CAST(p_partkey * 5 % 28 - 1 AS DOUBLE) END", "higher_lows": "p_partkey % 2 = 0", "ema21": f"CASE WHEN p_partkey % 43 > 0 THEN {QUOTED} * {real(47, 20, 100, 0.9)} END", "sma50": f"{QUOTED} * {real(59, 20, 100, 0.9)}", "pullback": f"CASE WHEN p_partkey % 47 > 0 THEN {real(61, 25, 100)} END",
    "rule": "'v2'", "before_at": f"CASE WHEN p_partkey % 5 > 0 THEN {NOW} - p_partkey * 67 % 300 * 1000 END", "before_rule": "CASE WHEN p_partkey % 7 = 0 THEN 'v1' WHEN p_partkey % 5 > 0 THEN 'v2' END", "before_pool": "CASE WHEN p_partkey % 11 = 0 THEN 'x' WHEN p_partkey % 5 > 0 THEN CAST(p_partkey % 9 AS VARCHAR(9)) END",
    "before_liquidity": f"CASE WHEN p_partkey % 5 > 0 THEN {LIQUIDITY} * {real(71, 40, 100, 0.85)} END",
}
GATES_SQL = [
    ("'Confirmed provider coverage unavailable'", "NOT covered"), ("'Research only: support unconfirmed'", "NOT tradeable"), ("'Security ' || security || ': ' || security_reasons", "security <> 'PASS'"), ("'Security result stale'", "at - checked_at > 60000 OR checked_at > at"), ("'Market data unavailable'", "NOT market"),
    ("'Five-minute volume below minimum'", "volume < 10000"), ("'Too few five-minute swaps'", "buys + sells < 30"), ("'Too few unique buyers'", "buyers < 20"), ("'Buy/sell transaction ratio too low'", "buys::DOUBLE / greatest(1, sells) < 1.2::DOUBLE"), ("'Buy/sell USD ratio too low'", "usd_ratio < 1.3::DOUBLE"),
    ("'Single buyer dominates flow'", "top_buyer > 0.2::DOUBLE"), ("'Top five buyers dominate flow'", "top_five > 0.6::DOUBLE"), ("'Market identity mismatch'", "market AND NOT matches"), ("'Pool age outside allowed range'", "market AND (at - created_at < 600000 OR at - created_at > 86400000)"),
    ("'Market data stale'", "market AND (at - fetched_at > 60000 OR fetched_at > at)"), ("'Liquidity below minimum'", "market AND liquidity < 50000"), ("'FDV/liquidity too high or unknown'", "market AND (fdv <= 0 OR fdv > 20 * liquidity)"), ("'Price invalid'", "market AND price <= 0"),
    ("'Five-minute price move extended or unknown'", "market AND greatest(price_change, coalesce(flow_change, 0)) > 25"), ("'Liquidity fell more than 10%'", "market AND before_rule = 'v2' AND at - before_at <= 180000 AND before_pool = pool AND liquidity < before_liquidity * 0.9::DOUBLE"),
]
cut = lambda x: f"least(greatest({x}, 0::DOUBLE), 1::DOUBLE)"
ROSE = "preceding_volume > 0 AND previous_volume > preceding_volume AND volume > previous_volume"
POINTS_SQL = {
    "liquidity_points": f"10 * {cut('liquidity / 150000')} + 10 * {cut('(20 - fdv / liquidity) / 15')} + CASE WHEN before_pool = pool AND liquidity >= before_liquidity THEN 5 ELSE 2 END",
    "buyers_points": f"10 * {cut('buyers / 100::DOUBLE')} + 8 * {cut('(usd_ratio - 1) / 1.5::DOUBLE')} + 7 * {cut('1 - top_five / 0.6::DOUBLE')}",
    "acceleration_points": f"CASE WHEN previous_volume > 0 THEN 10 * {cut('(volume / previous_volume - 1) / 1.5::DOUBLE')} ELSE 0 END + CASE WHEN {ROSE} THEN 5 ELSE 0 END + CASE WHEN minute_share <= 0.35::DOUBLE THEN 5 ELSE 0 END",
    "structure_points": "CASE WHEN higher_lows THEN 5 ELSE 0 END + CASE WHEN price > ema21 THEN 4 ELSE 0 END + CASE WHEN ema21 > sma50 THEN 3 ELSE 0 END + CASE WHEN pullback BETWEEN 0.01::DOUBLE AND 0.15::DOUBLE THEN 3 ELSE 0 END",
    "age_valuation_points": f"CASE WHEN at - created_at <= 43200000 THEN 8 ELSE 4 END + 7 * {cut('(20 - fdv / liquidity) / 15')}",
}
WHY_SQL = [("'Distributed buy flow'", "top_five < 0.3::DOUBLE"), ("'Rising volume across three windows'", ROSE), ("'Controlled pullback above 21 EMA'", "price > ema21 AND pullback BETWEEN 0.01::DOUBLE AND 0.15::DOUBLE"), ("'Liquidity comfortably above minimum'", "liquidity >= 100000")]
listed = lambda checks: "list_filter([" + ", ".join(f"CASE WHEN {c} THEN {n} END" for n, c in checks) + "], lambda x: x IS NOT NULL)"


@reg.query(f"""WITH cand AS (SELECT p_partkey, {", ".join(f"{v} AS {k}" for k, v in SNAPSHOT.items())} FROM part), r AS (SELECT *, {listed(GATES_SQL)} AS reasons, {listed(WHY_SQL)} AS why FROM cand),
s AS (SELECT p_partkey, reasons, CASE WHEN len(reasons) = 0 THEN why ELSE [] END AS why, {", ".join(f"CASE WHEN len(reasons) = 0 THEN floor(({v}) + 0.5::DOUBLE)::BIGINT END AS {k}" for k, v in POINTS_SQL.items())} FROM r), t AS (SELECT *, {" + ".join(POINTS_SQL)} AS score FROM s)
SELECT p_partkey, array_to_string(CASE WHEN score < 60 THEN ['Score below 60'] ELSE reasons END, '; ') AS reasons, array_to_string(why, '; ') AS why, {", ".join(POINTS_SQL)}, score, coalesce(score >= 60, false) AS qualifies FROM t""")
def evaluate_gates(spark, d):
    """The twenty gates in order, the five parts of the score and why where none fails, and the score's own gate."""
    snapshots = table(spark, d, "part").select("p_partkey", *[F.expr(v).alias(k) for k, v in SNAPSHOT.items()])
    return gates.evaluate(snapshots).select("p_partkey", F.array_join("reasons", "; ").alias("reasons"), F.array_join("why", "; ").alias("why"), *POINTS_SQL, "score", "qualifies")


@reg.query("SELECT p_partkey FROM part WHERE p_partkey * 13 % 2000 >= 240 AND p_partkey * 7919 % 200000 >= 50000 AND p_partkey * 104729 % 400000 >= 100000 AND NOT upper(p_brand) IN ('BRAND#2', 'BRAND#17') AND NOT regexp_matches(p_name, '(?i)bolt|wrapped')")
def watchlist_eligible(spark, d):
    p = table(spark, d, "part")
    ok = F.expr("p_partkey * 13 % 2000 >= 240 AND p_partkey * 7919 % 200000 >= 50000 AND p_partkey * 104729 % 400000 >= 100000")
    return p.where(ok & ~F.upper("p_brand").isin("BRAND#2", "BRAND#17") & ~F.col("p_name").rlike("(?i)bolt|wrapped")).select("p_partkey")


@reg.query("SELECT p_partkey FROM part WHERE regexp_matches(p_type, '(?i)^(standard|economy|promo)') AND p_size > 0")
def family_allow_list(spark, d):
    return table(spark, d, "part").where(F.col("p_type").rlike("(?i)^(standard|economy|promo)") & (F.col("p_size") > 0)).select("p_partkey")


@reg.query(f"WITH {CANDIDATES}, r AS (SELECT p_partkey, {checks_sql(gates.MARKET)} AS reasons FROM cand) SELECT p_partkey, array_to_string(list_filter(reasons, lambda x: x IN ('price', 'buyers unknown')), ',') AS warnings, array_to_string(list_filter(reasons, lambda x: NOT x IN ('price', 'buyers unknown')), ',') AS blockers FROM r")
def reasons_split(spark, d):
    """Reasons that warn, and those that block."""
    r = candidates(spark, d).select("p_partkey", gates.failed(gates.MARKET).alias("r"))
    soft = lambda x: x.isin("price", "buyers unknown")
    return r.select("p_partkey", F.array_join(F.filter("r", soft), ",").alias("warnings"), F.array_join(F.filter("r", lambda x: ~soft(x)), ",").alias("blockers"))


@reg.query("SELECT p_partkey FROM part WHERE p_partkey * 13 % 2000 >= 10 AND p_partkey * 13 % 2000 < 240 AND p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R' AND l_quantity >= 45)")
def young_cohort(spark, d):
    """Ages from ten minutes to four hours that were not seen before."""
    seen = table(spark, d, "lineitem").where("l_returnflag = 'R' AND l_quantity >= 45").select(F.col("l_partkey").alias("p_partkey"))
    return table(spark, d, "part").where(F.expr("p_partkey * 13 % 2000 >= 10 AND p_partkey * 13 % 2000 < 240")).join(seen, "p_partkey", "left_anti").select("p_partkey")


@reg.query(f"WITH {TRADES}, g AS (SELECT chain, at, at - lag(at) OVER (PARTITION BY chain ORDER BY at) > {12 * HOUR} AS gap FROM trades), l AS (SELECT chain, max(at) AS last FROM trades GROUP BY chain), n AS (SELECT max(at) AS now FROM trades) SELECT chain FROM l, n WHERE now - last <= {DAY} AND chain NOT IN (SELECT chain FROM g, n WHERE gap AND at > now - {7 * DAY})")
def covered_chains(spark, d):
    """Chains that are fresh and had no gap lately."""
    t = trades(spark, d)
    now = t.agg(F.max("at")).first()[0] or 0
    gaps = t.select("chain", "at", (F.col("at") - F.lag("at").over(Window.partitionBy("chain").orderBy("at")) > 12 * HOUR).alias("gap")).where(F.col("gap") & (F.col("at") > now - 7 * DAY))
    return t.groupBy("chain").agg(F.max("at").alias("last")).where(now - F.col("last") <= DAY).join(gaps, "chain", "left_anti").select("chain")


@reg.query(f"WITH {TRADES}, p AS (SELECT unnest(['p1', NULL]) AS pool) SELECT coalesce(p.pool, 'any') AS wanted, count(*) AS n FROM trades t JOIN p ON p.pool IS NULL OR t.pool = p.pool GROUP BY 1")
def parameter_filter(spark, d):
    """The same filter with its parameter given and left out."""
    counted = lambda pool: trades(spark, d).where(F.lit(True) if pool is None else F.col("pool") == pool).agg(F.count(F.lit(1)).alias("n")).select(F.lit(pool or "any").alias("wanted"), "n")
    return counted("p1").unionByName(counted(None))


PAPER = [("paused", "c_custkey % 11 = 0"), ("cash", "c_acctbal < 0"), ("held", "c_custkey % 7 = 0"), ("risk", "c_custkey % 5 = 0"), ("late", "c_acctbal > 9000")]


@reg.query("SELECT c_custkey, CASE " + " ".join(f"WHEN {c} THEN '{n}'" for n, c in PAPER) + " ELSE 'enter' END AS decision FROM customer")
def paper_gates(spark, d):
    """The first of the ordered reasons that holds."""
    return table(spark, d, "customer").select("c_custkey", F.coalesce(*[F.when(F.expr(c), F.lit(n)) for n, c in PAPER], F.lit("enter")).alias("decision"))


# ---- next bar: flags, tags, entries

NEXT = f"""{BARS}, nx AS (SELECT *, lead(open) OVER w AS o2, lead(close) OVER w AS c2, lead(volume) OVER w AS v2 FROM bars WINDOW w AS (PARTITION BY chain ORDER BY at))"""
# The tags that users see, and the factors of their conditions.
TAGS = [("next candle unavailable", "c2 IS NULL"), ("next candle red", "c2 <= o2"), ("next close below signal entry", "c2 < close"), ("lost signal-candle midpoint", "c2 < (open + close) / 2"), ("next-candle volume collapsed", "volume > 0 AND v2 / volume < 0.35"), ("fell back below support-zone top", "c2 < low * 1.035")]


def with_next(spark, d):
    w = ts.ordered(K)
    return bars(spark, d).select("*", *[F.lead(a).over(w).alias(b) for a, b in (("open", "o2"), ("close", "c2"), ("volume", "v2"))])


@reg.query(f"WITH {NEXT} SELECT chain, at, c2 >= close * 0.995::DOUBLE AS hold, c2 >= close * 0.995::DOUBLE AND c2 > o2 AS green_hold, c2 >= close * 0.995::DOUBLE AND volume > 0 AND v2 >= volume * 0.35::DOUBLE AS hold_volume, c2 >= close * 0.995::DOUBLE AND c2 > o2 AND volume > 0 AND v2 >= volume * 0.35::DOUBLE AS green_hold_volume FROM nx WHERE c2 IS NOT NULL")
def learning_flags(spark, d):
    hold, green = F.col("c2") >= F.col("close") * 0.995, F.col("c2") > F.col("o2")
    volume = (F.col("volume") > 0) & (F.col("v2") >= F.col("volume") * 0.35)
    return with_next(spark, d).where("c2 IS NOT NULL").select("chain", "at", hold.alias("hold"), (hold & green).alias("green_hold"), (hold & volume).alias("hold_volume"), (hold & green & volume).alias("green_hold_volume"))


@reg.query(f"WITH {NEXT}, t AS (SELECT chain, at, {checks_sql([(n, c.replace('0.35', '0.35::DOUBLE').replace('1.035', '1.035::DOUBLE')) for n, c in TAGS])} AS tags FROM nx) SELECT chain, at, CASE WHEN len(tags) = 0 THEN 'no immediate confirmation failure' ELSE array_to_string(tags, ',') END AS tags FROM t")
def failure_tags(spark, d):
    tags = screening.reasons([(n, F.expr(c.replace("0.35", "0.35D").replace("1.035", "1.035D"))) for n, c in TAGS])
    t = with_next(spark, d).select("chain", "at", tags.alias("t"))
    return t.select("chain", "at", F.when(F.size("t") == 0, "no immediate confirmation failure").otherwise(F.array_join("t", ",")).alias("tags"))


@reg.query(f"WITH {NEXT} SELECT chain, at, o2 >= greatest(low, close * 0.99::DOUBLE) AND o2 <= least(close * 1.02::DOUBLE, low * 0.995::DOUBLE / 0.9::DOUBLE) AS available FROM nx WHERE o2 IS NOT NULL")
def entry_available(spark, d):
    """Whether the next bar opens within the plan's range of entry prices."""
    p = screening.trade_plan(F.col("low"), F.col("close"))
    return with_next(spark, d).where("o2 IS NOT NULL").select("chain", "at", F.col("o2").between(p["entry_min"], p["entry_max"]).alias("available"))


@reg.query(f"WITH {NEXT}, f AS (SELECT chain, at, (c2 / close - 1) * 100 AS ret, 1 - low * 0.995::DOUBLE / close AS risk FROM nx WHERE c2 IS NOT NULL) SELECT chain, at, round(CASE WHEN ret >= 5 THEN 5 / (risk * 100) WHEN ret <= -risk * 100 THEN -1 END, 6) AS r, CASE WHEN ret >= 5 THEN (5 / (risk * 100) >= 1)::INT WHEN ret <= -risk * 100 THEN 0 END AS y FROM f WHERE risk > 0")
def r_multiple(spark, d):
    """+5 % in units of the risk, or -1 at the stop; y is whether it is 1 or more."""
    f = with_next(spark, d).where("c2 IS NOT NULL").select("chain", "at", ((F.col("c2") / F.col("close") - 1) * 100).alias("ret"), (1 - F.col("low") * 0.995 / F.col("close")).alias("risk")).where("risk > 0")
    r = F.when(F.col("ret") >= 5, 5 / (F.col("risk") * 100)).when(F.col("ret") <= -F.col("risk") * 100, F.lit(-1.0))
    return f.select("chain", "at", F.round(r, 6).alias("r"), (r >= 1).cast("int").alias("y"))


@reg.query(f"WITH {BARS}, w AS (SELECT *, min(low) OVER (PARTITION BY chain ORDER BY at ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS range_low, bool_or(low <= close * 0.9::DOUBLE) OVER (PARTITION BY chain ORDER BY at ROWS BETWEEN 7 PRECEDING AND CURRENT ROW) AS touched, close - lag(close, 3) OVER (PARTITION BY chain ORDER BY at) AS slope3 FROM bars) SELECT chain, at, range_low, touched, round(slope3, 6) AS slope3 FROM w")
def recent_range(spark, d):
    w = ts.ordered(K)
    return r6(bars(spark, d).select("chain", "at", F.min("low").over(w.rowsBetween(-4, 0)).alias("range_low"), F.bool_or(F.col("low") <= F.col("close") * 0.9).over(w.rowsBetween(-7, 0)).alias("touched"), (F.col("close") - F.lag("close", 3).over(w)).alias("slope3")), "slope3")


@reg.query(f"WITH {BARS}, n AS (SELECT chain, max(at) - {10 * DAY} AS last_at FROM bars GROUP BY chain) SELECT chain, b.at FROM bars b JOIN n USING (chain) WHERE b.at > last_at")
def bar_cursor(spark, d):
    """Bars after each key's cursor; those at or before it are done."""
    b = bars(spark, d).select("chain", "at")
    cursor = b.groupBy("chain").agg((F.max("at") - 10 * DAY).alias("last_at"))
    return b.join(cursor, "chain").where("at > last_at").select("chain", "at")


# ---- outcomes

@reg.query(f"""WITH {TRADES}, f AS (SELECT trader, first(at ORDER BY at, id) AS t0, first(price ORDER BY at, id) AS entry FROM trades GROUP BY trader),
j AS (SELECT f.*, t.at, t.id, t.price FROM f JOIN trades t USING (trader)),
g AS (SELECT trader, any_value(entry) AS entry, arg_min(price, (at, id)) FILTER (at >= t0 + {DAY} AND at <= t0 + {3 * DAY}) AS price, max(price) FILTER (at <= t0 + {DAY}) AS hi, min(price) FILTER (at <= t0 + {DAY}) AS lo FROM j GROUP BY trader)
SELECT trader, round((price / entry - 1) * 100, 6) AS ret, round((hi / entry - 1) * 100, 6) AS mfe, round((lo / entry - 1) * 100, 6) AS mae, (price / entry - 1) * 100 >= 20 AND (lo / entry - 1) * 100 >= -10 AS hit FROM g""")
def spot_outcome(spark, d):
    """Return at the first price a day later, excursions until then, and whether that is a hit; null without such a price."""
    w = Window.partitionBy("trader").orderBy("at", "id")
    t = trades(spark, d).select("trader", "at", "id", "price", F.first("at").over(w).alias("t0"), F.first("price").over(w).alias("entry"))
    late, early = (F.col("at") >= F.col("t0") + DAY) & (F.col("at") <= F.col("t0") + 3 * DAY), F.col("at") <= F.col("t0") + DAY
    g = t.groupBy("trader").agg(F.first("entry").alias("entry"), F.min(F.when(late, F.struct("at", "id", "price"))).alias("end"), F.max(F.when(early, F.col("price"))).alias("hi"), F.min(F.when(early, F.col("price"))).alias("lo"))
    pct = lambda c: (c / F.col("entry") - 1) * 100
    ret, mae = pct(F.col("end.price")), pct(F.col("lo"))
    return r6(g.select("trader", ret.alias("ret"), pct(F.col("hi")).alias("mfe"), mae.alias("mae"), ((ret >= 20) & (mae >= -10)).alias("hit")), "ret", "mfe", "mae")


@reg.query(f"""WITH {TRADES}, f AS (SELECT *, first_value(price) OVER w AS e, first_value(at) OVER w AS t0 FROM trades WINDOW w AS (PARTITION BY trader ORDER BY at, id)),
g AS (SELECT trader, min(at) FILTER (price <= e * 0.9::DOUBLE) AS stop_at, min(at) FILTER (price >= e * 1.1::DOUBLE) AS tp1_at, min(at) FILTER (price >= e * 1.2::DOUBLE) AS tp2_at, min(price) AS low, max(price) AS high, max(at) - min(t0) >= {DAY} AS complete FROM f GROUP BY trader)
SELECT trader, CASE WHEN stop_at IS NULL AND tp1_at IS NULL THEN NULL WHEN tp1_at IS NULL OR stop_at <= tp1_at THEN 'stop' ELSE 'tp1' END AS first_hit, CASE WHEN tp1_at IS NULL OR stop_at <= tp1_at THEN stop_at END AS stop_at, tp1_at, tp2_at, low, high, complete FROM g""")
def alert_outcome(spark, d):
    """What came first, when each level was reached, extremes, and whether a day is over."""
    return gates.first_hits(trades(spark, d), "trader", 0.9, 1.1, 1.2, DAY)


@reg.query(f"WITH {FILLS} SELECT rule, chain, count(*) AS total, count(*) FILTER (n <= 4) AS complete, round(median(net_bp) FILTER (n <= 4), 6) AS median, min(net_bp) FILTER (n <= 4) AS worst, round(avg((net_bp >= 500)::INT::DOUBLE) FILTER (n <= 4), 6) AS hit_rate FROM fills GROUP BY rule, chain")
def outcome_rollup(spark, d):
    v = F.when(F.col("n") <= 4, F.col("net_bp"))
    g = fills(spark, d).groupBy("rule", "chain").agg(F.count(F.lit(1)).alias("total"), F.count(v).alias("complete"), F.median(v).alias("median"), F.min(v).alias("worst"), F.avg((v >= 500).cast("double")).alias("hit_rate"))
    return r6(g, "median", "hit_rate")


PAIRED = f"""{PAIRS}, pq AS (SELECT rule, m, round(diff * 1000)::BIGINT AS v FROM pd), pb AS (SELECT *, row_number() OVER (PARTITION BY rule ORDER BY m) - 1 AS i, count(*) OVER (PARTITION BY rule) AS k FROM pq),
pk AS (SELECT rule, rep, ({resample.draw_sql(13, 'rep', 'i')}) % k AS i FROM pb, range(1000) g(rep)), pm AS (SELECT pk.rule, rep, sum(v)::DOUBLE / count(*) AS mean FROM pk JOIN pb ON pb.rule = pk.rule AND pb.i = pk.i GROUP BY ALL),
pe AS (SELECT rule, quantile_cont(mean, 0.025) AS low, quantile_cont(mean, 0.975) AS high FROM pm GROUP BY rule),
paired AS (SELECT rule, sum(v)::DOUBLE / count(*) AS mean, count(*) AS days, any_value(CASE WHEN k >= 3 AND high > low THEN low END) AS low, any_value(CASE WHEN k >= 3 AND high > low THEN high END) AS high FROM pb JOIN pe USING (rule) GROUP BY rule)"""


def paired(spark, d):
    days = paired_days(spark, d).select("rule", F.col("m").alias("day"), F.round(F.col("diff") * 1000).cast("long").alias("v"))
    return resample.bootstrap(days, R, "day", F.col("v"), 1000, 13)


@reg.query(f"WITH {PAIRED} SELECT rule, round(mean, 6) AS mean, days, round(low, 6) AS low, round(high, 6) AS high FROM paired")
def paired_block_bootstrap(spark, d):
    """Difference of the populations' means over days that both have, with its interval by resampling such days."""
    return r6(paired(spark, d), "mean", "low", "high")


@reg.query(f"""WITH {PAIRED}, sd AS (SELECT rule, day, bool_or(signal) AS s, bool_or(NOT signal) AS c FROM fills GROUP BY ALL), j AS (SELECT f.*, s AND c AS shared FROM fills f JOIN sd USING (rule, day)),
d AS (SELECT rule, count(*) FILTER (s) AS signal_days, count(*) FILTER (c) AS control_days, count(*) FILTER (s AND c) AS shared_days FROM sd GROUP BY rule),
g AS (SELECT rule, count(*) FILTER (signal) AS signals, count(*) FILTER (NOT signal) AS controls, avg(net_bp) FILTER (signal) AS signal_mean, avg(net_bp) FILTER (NOT signal) AS control_mean, avg(net_bp) FILTER (signal AND shared) - avg(net_bp) FILTER (NOT signal AND shared) AS edge FROM j GROUP BY rule)
SELECT rule, signals, controls, signal_days, control_days, shared_days, round(signal_mean, 6) AS signal_mean, round(control_mean, 6) AS control_mean, round(edge, 6) AS edge,
  array_to_string(list_filter([CASE WHEN signals < 180 THEN 'signals' END, CASE WHEN signal_days < 20 THEN 'days' END, CASE WHEN low IS NULL OR low <= 0 THEN 'edge' END], lambda x: x IS NOT NULL), ',') AS blockers FROM g JOIN d USING (rule) LEFT JOIN paired USING (rule)""")
def forward_shadow_summary(spark, d):
    """Per rule: sizes, days, expectancies, the edge over shared days, and what still blocks promotion."""
    f = fills(spark, d)
    days = f.groupBy("rule", "day").agg(F.bool_or("signal").alias("s"), F.bool_or(~F.col("signal")).alias("c"))
    counted = days.groupBy("rule").agg(F.count_if("s").alias("signal_days"), F.count_if("c").alias("control_days"), F.count_if(F.expr("s AND c")).alias("shared_days"))
    mean = lambda c: F.avg(F.when(F.expr(c), F.col("net_bp")))
    j = f.join(days.select("rule", "day", F.expr("s AND c").alias("shared")), ["rule", "day"])
    g = j.groupBy("rule").agg(F.count_if("signal").alias("signals"), F.count_if(~F.col("signal")).alias("controls"), mean("signal").alias("signal_mean"), mean("NOT signal").alias("control_mean"), (mean("signal AND shared") - mean("NOT signal AND shared")).alias("edge"))
    both = g.join(counted, "rule").join(paired(spark, d).select("rule", "low"), "rule", "left")
    blockers = screening.reasons([("signals", F.col("signals") < 180), ("days", F.col("signal_days") < 20), ("edge", F.col("low").isNull() | (F.col("low") <= 0))])
    return r6(both.select("rule", "signals", "controls", "signal_days", "control_days", "shared_days", "signal_mean", "control_mean", "edge", F.array_join(blockers, ",").alias("blockers")), "signal_mean", "control_mean", "edge")


@reg.query(f"WITH {FILLS} SELECT day FROM fills WHERE signal INTERSECT SELECT day FROM fills WHERE NOT signal")
def shared_days(spark, d):
    f = fills(spark, d)
    return f.where("signal").select("day").intersect(f.where("NOT signal").select("day"))


@reg.query(f"WITH {FILLS}, q AS (SELECT *, o * 37 % 101 AS score, quantile_cont(o * 37 % 101, 0.9) OVER (PARTITION BY rule) AS cut FROM fills) SELECT rule, count(*) AS n, round(avg(net_bp), 6) AS mean FROM q WHERE score >= cut GROUP BY rule")
def top_decile(spark, d):
    """Rows at or above their fold's 0.9 quantile of the score."""
    f = fills(spark, d).select("rule", "net_bp", (F.col("o") * 37 % 101).alias("score"))
    cuts = f.groupBy("rule").agg(F.percentile("score", F.lit(0.9)).alias("cut"))
    return r6(f.join(cuts, "rule").where("score >= cut").groupBy("rule").agg(F.count(F.lit(1)).alias("n"), F.avg("net_bp").alias("mean")), "mean")


@reg.query(f"WITH {FILLS} SELECT o, n, CASE WHEN n <= 4 THEN net_bp END AS net, CASE WHEN n <= 4 OR net_bp >= 1000 THEN greatest(net_bp, 0) END AS best FROM fills")
def resolved_mask(spark, d):
    """Returns of open rows are null, and so are their highest multiples below the bound."""
    done = F.col("n") <= 4
    return fills(spark, d).select("o", "n", F.when(done, F.col("net_bp")).alias("net"), F.when(done | (F.col("net_bp") >= 1000), F.greatest("net_bp", F.lit(0))).alias("best"))


@reg.query(f"""WITH {FILLS}, s AS (SELECT unnest(['hold', 'early', 'big']) AS screen, unnest([n >= 3, o % 2 = 0, usd >= 40000]) AS keep, net_bp > 0 AS won FROM fills), g AS (SELECT screen, count(*) FILTER (NOT keep AND NOT won) - count(*) FILTER (NOT keep AND won) + avg((won)::INT::DOUBLE) FILTER (keep) / 1000 AS score FROM s GROUP BY screen)
SELECT screen, round(score, 6) AS score FROM g ORDER BY g.score DESC, screen LIMIT 1""")
def screen_choice(spark, d):
    """The screen with most losses avoided less winners missed, ties by the winners' rate among what it keeps."""
    screens = {"hold": F.col("n") >= 3, "early": F.col("o") % 2 == 0, "big": F.col("usd") >= 40000}
    s = fills(spark, d).select((F.col("net_bp") > 0).alias("won"), F.inline(F.array(*[F.struct(F.lit(k).alias("screen"), v.alias("keep")) for k, v in screens.items()])))
    g = s.groupBy("screen").agg((F.count_if(F.expr("NOT keep AND NOT won")) - F.count_if(F.expr("NOT keep AND won")) + F.avg(F.when(F.col("keep"), F.col("won").cast("double"))) / 1000).alias("score"))
    return r6(g.orderBy(F.col("score").desc(), "screen").limit(1), "score")


@reg.query(f"WITH {FILLS}, v AS (SELECT rule, chain, avg(net_bp) AS mean, count(*) AS n FROM fills GROUP BY ALL) SELECT rule, chain, row_number() OVER (ORDER BY mean DESC, n DESC, rule, chain) AS place FROM v")
def variant_ranking(spark, d):
    v = fills(spark, d).groupBy("rule", "chain").agg(F.avg("net_bp").alias("mean"), F.count(F.lit(1)).alias("n"))  # a row a variant
    return v.select("rule", "chain", F.row_number().over(Window.orderBy(F.col("mean").desc(), F.col("n").desc(), "rule", "chain")).cast("long").alias("place"))


@reg.query(f"WITH {FILLS} SELECT rule, count(*) AS n, round(avg(net_bp), 6) AS mean, round(stddev_samp(net_bp), 6) AS std, round(median(net_bp), 6) AS median, count(*) - count(CASE WHEN n <= 4 THEN net_bp END) AS missing FROM fills GROUP BY rule")
def describe_values(spark, d):
    g = fills(spark, d).groupBy("rule").agg(F.count(F.lit(1)).alias("n"), F.avg("net_bp").alias("mean"), F.stddev_samp("net_bp").alias("std"), F.median("net_bp").alias("median"), F.count_if(F.col("n") > 4).alias("missing"))
    return r6(g, "mean", "std", "median")


@reg.query(f"WITH {FILLS} SELECT o, " + ", ".join(f"sum(net_bp) FILTER (rule = 'r{k}')::BIGINT AS r{k}" for k in range(6)) + " FROM fills GROUP BY o")
def pivot_rules(spark, d):
    """Long to wide: a column a rule, of which there are six."""
    return fills(spark, d).groupBy("o").pivot("rule", [f"r{k}" for k in range(6)]).agg(F.sum("net_bp"))


@reg.query(f"WITH {TRADES} SELECT chain, count(DISTINCT at // {HOUR}) AS active_hours, count(*) AS n, count(DISTINCT trader) AS traders, min(at) AS since, max(at) AS until FROM trades GROUP BY chain")
def collector_coverage(spark, d):
    return trades(spark, d).groupBy("chain").agg(F.count_distinct(F.expr(f"at div {HOUR}")).alias("active_hours"), F.count(F.lit(1)).alias("n"), F.count_distinct("trader").alias("traders"), F.min("at").alias("since"), F.max("at").alias("until"))


@reg.query(f"WITH {TRADES} SELECT DISTINCT chain, at // 60000 AS minute FROM trades WHERE side = 'buy'")
def healthy_minutes(spark, d):
    return trades(spark, d).where("side = 'buy'").select("chain", F.expr("at div 60000").alias("minute")).distinct()


# ---- stored state: an order stands for a row

@reg.query(f"WITH {ORD}, m AS (SELECT id % 1000 AS k, at, id, status, CASE WHEN id % 3 = 0 THEN NULL ELSE v END AS v FROM o) SELECT k, arg_max(status, (at, id)) AS status, arg_max(v, (at, id)) FILTER (v IS NOT NULL) AS v, arg_min(id, (at, id)) AS plan FROM m GROUP BY k")
def json_merge_upsert(spark, d):
    """Later values win field by field, fields they lack stay, and one field keeps its first value."""
    m = order_rows(spark, d).select((F.col("id") % 1000).alias("k"), F.struct("at", "id").alias("ord"), "status", F.when(F.col("id") % 3 != 0, F.col("v")).alias("v"), F.col("id").alias("plan"))
    return ledger.merge_fields(m, ["k"], "ord", ["status", "v"], ["plan"])


@reg.query("SELECT o_orderkey, o_orderstatus AS state, CASE WHEN o_orderkey % 4 = 0 THEN 'patched' ELSE o_orderpriority END AS detail FROM orders")
def json_patch(spark, d):
    """One nested field of some rows replaced, the others as they were."""
    doc = F.struct(F.col("o_orderstatus").alias("state"), F.struct(F.col("o_orderpriority").alias("detail")).alias("data"))
    o = table(spark, d, "orders").select("o_orderkey", doc.alias("doc"))
    patched = F.when(F.col("o_orderkey") % 4 == 0, F.col("doc").withField("data.detail", F.lit("patched"))).otherwise(F.col("doc"))
    return o.select("o_orderkey", patched.alias("doc")).select("o_orderkey", "doc.state", F.col("doc.data.detail").alias("detail"))


@reg.query(f"WITH {ORD}, n AS (SELECT max(at) AS now FROM o) SELECT id, CASE WHEN status IN ('O', 'P') AND at < now - {30 * DAY} THEN 'unknown' WHEN status = 'P' THEN 'sending' WHEN status = 'O' THEN 'reserved' ELSE 'sent' END AS status FROM o, n")
def guarded_transition(spark, d):
    """Reserved and sending rows beyond their time become unknown; nothing else moves."""
    o = order_rows(spark, d)
    now = o.agg(F.max("at")).first()[0] or 0
    named = F.when(F.col("status") == "P", "sending").when(F.col("status") == "O", "reserved").otherwise("sent")
    return ledger.transition(o.select("id", "at", named.alias("status")), ["reserved", "sending"], "unknown", F.col("at") < now - 30 * DAY).select("id", "status")


@reg.query(f"WITH {TRADES} SELECT id FROM trades WHERE at >= (SELECT max(at) FROM trades) - {2 * DAY}")
def ttl_delete(spark, d):
    t = trades(spark, d)
    return ledger.retained(t, "at", t.agg(F.max("at")).first()[0] or 0, 2 * DAY).select("id")


@reg.query(f"WITH {ORD} SELECT token, array_to_string(list(id ORDER BY at, id) FILTER (status = 'F'), ',') AS ids FROM o GROUP BY token")
def ordered_list(spark, d):
    """Ids of a token's done rows in time order, null if there are none."""
    got = F.array_sort(F.collect_list(F.when(F.col("status") == "F", F.struct("at", "id"))))
    g = order_rows(spark, d).groupBy("token").agg(got.alias("g"))
    return g.select("token", F.when(F.size("g") > 0, F.array_join(F.transform("g", lambda x: x["id"].cast("string")), ",")).alias("ids"))


@reg.query(f"WITH {ORD} SELECT token, map_from_entries(list((status, n) ORDER BY status))['F'] AS done, len(map_keys(map_from_entries(list((status, n) ORDER BY status)))) AS kinds FROM (SELECT token, status, count(*) AS n FROM o GROUP BY ALL) GROUP BY token")
def status_map(spark, d):
    """Counts by status as a map of a few keys."""
    g = order_rows(spark, d).groupBy("token", "status").agg(F.count(F.lit(1)).alias("n")).groupBy("token").agg(F.map_from_entries(F.collect_list(F.struct("status", "n"))).alias("m"))
    return g.select("token", F.col("m")["F"].alias("done"), F.size(F.map_keys("m")).cast("long").alias("kinds"))


# ---- joins and orders

@reg.query("SELECT l_orderkey, l_linenumber, c_name FROM lineitem JOIN orders ON o_orderkey = l_orderkey AND o_orderdate < l_shipdate JOIN customer ON c_custkey = o_custkey")
def three_way_join(spark, d):
    li, o, c = (table(spark, d, t) for t in ("lineitem", "orders", "customer"))
    return li.join(o, (F.col("o_orderkey") == F.col("l_orderkey")) & (F.col("o_orderdate") < F.col("l_shipdate"))).join(c, F.col("c_custkey") == F.col("o_custkey")).select("l_orderkey", "l_linenumber", "c_name")


@reg.query(f"WITH {TRADES}, k AS (SELECT chain, pool, side, max(price) AS best FROM trades GROUP BY ALL) SELECT id, best FROM trades JOIN k USING (chain, pool, side)")
def exact_lookup(spark, d):
    t = trades(spark, d)
    return t.join(t.groupBy("chain", "pool", "side").agg(F.max("price").alias("best")), ["chain", "pool", "side"]).select("id", "best")


@reg.query(f"WITH {FILLS} SELECT a.o, a.n, a.net_bp AS net_model, b.net_bp AS net_rule FROM fills a JOIN fills b ON a.o = b.o AND a.day = b.day AND a.chain = b.chain WHERE a.signal AND NOT b.signal")
def suffix_join(spark, d):
    """Rows of two populations that agree in three keys, side by side."""
    f = fills(spark, d)
    a, b = f.where("signal").select("o", "day", "chain", "n", F.col("net_bp").alias("net_model")), f.where("NOT signal").select("o", "day", "chain", F.col("net_bp").alias("net_rule"))
    return a.join(b, ["o", "day", "chain"]).select("o", "n", "net_model", "net_rule")


@reg.query(f"WITH {ORD}, w AS (SELECT token, id, at, row_number() OVER (PARTITION BY token ORDER BY at, id) AS k FROM o WHERE status = 'O'), r AS (SELECT token, at, row_number() OVER (PARTITION BY token ORDER BY at, id) AS k FROM o WHERE status = 'F') SELECT w.id, r.at - w.at AS delay FROM w LEFT JOIN r ON w.token = r.token AND w.k = r.k")
def event_pairing(spark, d):
    """The k-th warning of a key with its k-th recovery, if there is one."""
    o = order_rows(spark, d)
    side = lambda s, *c: o.where(F.col("status") == s).select("token", *c, F.row_number().over(Window.partitionBy("token").orderBy("at", "id")).alias("k"))
    return side("O", "id", "at").join(side("F", F.col("at").alias("end")), ["token", "k"], "left").select("id", (F.col("end") - F.col("at")).alias("delay"))


@reg.query("WITH s AS (SELECT o_orderkey AS k, o_orderdate AS t, o_orderstatus = 'P' AS pending FROM orders), r AS (SELECT *, row_number() OVER (ORDER BY t, k) AS i FROM s), q AS (SELECT *, row_number() OVER (ORDER BY i > 5, CASE WHEN i > 5 THEN NOT pending END, i) AS place FROM r) SELECT k, place FROM q WHERE place <= 10")
def fair_refresh(spark, d):
    """The five oldest first, then pending ones, then by age; ten in all."""
    s = table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderdate").alias("t"), (F.col("o_orderstatus") == "P").alias("pending"))
    oldest = s.orderBy("t", "k").limit(5)
    rest = s.join(oldest, "k", "left_anti").orderBy(~F.col("pending"), "t", "k").limit(5)
    both = oldest.withColumn("late", F.lit(0)).unionByName(rest.withColumn("late", F.lit(1)))  # ten rows
    return both.select("k", F.row_number().over(Window.orderBy("late", F.when(F.col("late") == 1, ~F.col("pending")), "t", "k")).cast("long").alias("place"))


@reg.query("SELECT event_id FROM events ORDER BY TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) DESC NULLS LAST, event_id LIMIT 500")
def shortlist_order(spark, d):
    return table(spark, d, "events").orderBy(F.get_json_object("props", "$.k").try_cast("double").desc_nulls_last(), "event_id").limit(500).select("event_id")


@reg.query("WITH d AS (SELECT o_custkey, min(o_orderdate) AS t FROM orders WHERE o_orderstatus = 'O' GROUP BY 1) SELECT o_custkey, t FROM d ORDER BY t, o_custkey LIMIT 1")
def oldest_pending(spark, d):
    return table(spark, d, "orders").where("o_orderstatus = 'O'").groupBy("o_custkey").agg(F.min("o_orderdate").alias("t")).orderBy("t", "o_custkey").limit(1)


@reg.query("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 5")
def last_resolved(spark, d):
    return table(spark, d, "orders").where("o_orderstatus = 'F'").orderBy(F.col("o_orderdate").desc(), F.col("o_orderkey").desc()).limit(5).select("o_orderkey")


@reg.query("SELECT o_orderkey, coalesce(CASE WHEN o_orderstatus = 'F' THEN o_clerk END, o_orderpriority) AS setup, round((epoch_us(TIMESTAMP '2002-01-01') - epoch_us(o_orderdate)) / 3600000000.0::DOUBLE, 4) AS age_hours FROM orders".replace("o_clerk", "o_orderpriority || '!'"))
def setup_context(spark, d):
    """The setup of a row, or for a control the compatible one, and its age in hours."""
    age = (F.unix_micros(F.lit("2002-01-01 00:00:00").cast("timestamp")) - F.unix_micros(F.col("o_orderdate").cast("timestamp"))) / 3_600_000_000.0
    return table(spark, d, "orders").select("o_orderkey", F.coalesce(F.when(F.col("o_orderstatus") == "F", F.concat("o_orderpriority", F.lit("!"))), F.col("o_orderpriority")).alias("setup"), F.round(age, 4).alias("age_hours"))


@reg.query("SELECT doc_id, ((row_number() OVER (PARTITION BY toxic ORDER BY md5(doc_id::VARCHAR), doc_id) - 1) % 5)::INT AS fold FROM labels")
def naive_folds(spark, d):
    """Stratified folds in a shuffled order, blind to time: the baseline that the purged ones are held against."""
    order = Window.partitionBy("toxic").orderBy(F.md5(F.col("doc_id").cast("string").cast("binary")), "doc_id")
    return table(spark, d, "labels").select("doc_id", ((F.row_number().over(order) - 1) % 5).cast("int").alias("fold"))


# ---- sources

@reg.query("SELECT p_partkey, p_brand AS pool, CASE WHEN p_size % 4 <> 0 THEN p_retailprice END AS price, p_size::DOUBLE AS liquidity, CASE WHEN p_size % 3 <> 0 THEN 'https://dexscreener.com/' || p_partkey END AS link, NULL::DOUBLE AS volume24 FROM part")
def market_parse(spark, d):
    """Market records as JSON text: bad prices, links that are not safe and missing fields become null."""
    p = table(spark, d, "part")
    raw = F.to_json(F.struct(
        F.col("p_brand").alias("pairAddress"), F.when(F.col("p_size") % 4 == 0, "n/a").otherwise(F.col("p_retailprice").cast("string")).alias("priceUsd"),
        F.when(F.col("p_size") % 3 == 0, "http://dexscreener.com/x").otherwise(F.concat(F.lit("https://dexscreener.com/"), F.col("p_partkey").cast("string"))).alias("url"),
        F.struct(F.col("p_size").alias("usd")).alias("liquidity"),
    ))
    m = p.select("p_partkey", raw.alias("raw")).select("p_partkey", normalize.market(F.col("raw")).alias("m"))
    return m.select("p_partkey", "m.pool", "m.price", "m.liquidity", "m.link", "m.volume24")


@reg.query(f"WITH {TRADES}, n AS (SELECT max(at) AS now FROM trades) SELECT id FROM trades, n WHERE at > now - {6 * HOUR} ORDER BY at DESC, id LIMIT 100")
def freshest_trades(spark, d):
    t = trades(spark, d)
    return tables.fresh(t, t.agg(F.max("at")).first()[0] or 0, 6 * HOUR, order=["id"]).select("id")


@reg.query(f"WITH {BARS} SELECT chain, at, open, high, low, close, volume FROM bars")
def json_bars_round_trip(spark, d):
    """Bars written as a folder of JSON files, a row a key, and scanned again."""
    rows = F.array_sort(F.collect_list(F.array(F.col("at").cast("double"), "open", "high", "low", "close", "volume"))).alias("rows")
    path = f"{shared_folder(spark)}/bars-{uuid.uuid4().hex}"
    bars(spark, d).groupBy(F.col("chain").alias("key")).agg(rows).write.json(path)
    return tables.json_bars(spark, path, lines=True).withColumnRenamed("key", "chain")


@reg.query(f"WITH {FILLS} SELECT o, n, day, rule, CASE WHEN o % 2 = 0 THEN rule END AS maybe, net_bp::DOUBLE AS net FROM fills")
def csv_round_trip(spark, d):
    """Rows written as gzip CSV and scanned with their types checked."""
    path = f"{shared_folder(spark)}/fills-{uuid.uuid4().hex}"
    sinks.csv(fills(spark, d).select("o", "n", "day", "rule", F.when(F.col("o") % 2 == 0, F.col("rule")).alias("maybe"), F.col("net_bp").alias("net")), path, "gzip")
    back = tables.csv(spark, path, ["o", "n", "day", "rule"], ["maybe", "net"], numeric=["net"])
    return back.select(F.col("o").cast("long").alias("o"), F.col("n").cast("int").alias("n"), "day", "rule", "maybe", "net")


@reg.query(f"WITH {TRADES}, s AS (SELECT *, min(at) OVER () AS lo FROM trades), l AS (SELECT id, at, unnest(range(13)) AS level, lo FROM s), c AS (SELECT level, (at - lo) // ({64 * DAY} // (1 << level)) AS part, count(*) AS n FROM l GROUP BY ALL), k AS (SELECT s.id, min(c.level) AS level FROM s JOIN l USING (id) JOIN c ON c.level = l.level AND c.part = (l.at - l.lo) // ({64 * DAY} // (1 << l.level)) WHERE c.n <= 50 OR c.level = 12 GROUP BY s.id), f AS (SELECT k.*, c.n > 50 AS saturated FROM k JOIN l USING (id, level) JOIN c ON c.level = l.level AND c.part = (l.at - l.lo) // ({64 * DAY} // (1 << l.level)))\nSELECT level, saturated, count(*) AS n FROM f GROUP BY level, saturated")
def bisected_ranges(spark, d):
    """Rows by how often the time span is halved until a range holds 50 rows at most."""
    t = trades(spark, d).select("id", "at")
    return ledger.bisected(t, "id", "at", 64 * DAY, 50, 12).groupBy("level", "saturated").agg(F.count(F.lit(1)).alias("n"))


# ---- evidence before a rollout

RULES = rollout.Evidence(span=7 * DAY, slot=HOUR, missing=14, gap=3 * HOUR, after=HOUR, before=3 * HOUR, order_usd=100.0, impact=4.0, liquidity=1_000.0, kept=0.01, accepted=0.3, apart=HOUR // 60)
UNTIL = 1_706_659_200_000  # 31 January 2024


@reg.query(f"""WITH {TRADES}, w AS (SELECT * FROM trades WHERE at >= {UNTIL} - {7 * DAY} AND at <= {UNTIL}), h AS (SELECT DISTINCT chain, at // {HOUR} * {HOUR} AS at FROM w), g AS (SELECT chain, at - lag(at) OVER (PARTITION BY chain ORDER BY at) AS gap FROM h), o AS (SELECT chain, count(*) AS slots, max(gap) AS widest FROM g GROUP BY chain),
f AS (SELECT * FROM w WHERE id % 5 = 0 AND at <= {UNTIL} - {3 * HOUR}), s AS (SELECT f.id, arg_min(t.usd * 200, (t.at, t.usd)) AS seen FROM f JOIN trades t ON t.trader = f.trader AND t.at >= f.at + {HOUR} AND t.at <= f.at + {3 * HOUR} GROUP BY f.id),
a AS (SELECT chain, count(*) AS total, count(*) FILTER (id % 4 > 0 AND id % 7 <= 4 AND seen >= 1000 AND seen >= usd * 200 * 0.01::DOUBLE) AS passed FROM f LEFT JOIN s USING (id) GROUP BY chain),
d AS (SELECT DISTINCT t.chain FROM trades t WHERE EXISTS (SELECT 1 FROM trades u WHERE u.chain = t.chain AND u.trader = t.trader AND u.id <> t.id AND abs(u.at - t.at) < {HOUR // 60})),
b AS (SELECT chain, min(at) AS started FROM trades GROUP BY chain)
SELECT chain AS scope, slots, widest, passed, total, array_to_string(list_filter([CASE WHEN {UNTIL} - started < {7 * DAY} THEN 'days' END, CASE WHEN slots < {7 * 24 - 14} THEN 'coverage' END, CASE WHEN widest > {3 * HOUR} THEN 'gap' END, CASE WHEN passed / total < 0.3::DOUBLE THEN 'acceptance' END, CASE WHEN d.chain IS NOT NULL THEN 'duplicates' END], lambda x: x IS NOT NULL), ',') AS blockers
FROM b JOIN o USING (chain) JOIN a USING (chain) LEFT JOIN d USING (chain)""")
def rollout_evidence(spark, d):
    """Each chain's gates: days, hours observed, gaps, references borne out by a review and a later sample, repeated messages."""
    t = trades(spark, d).withColumnRenamed("chain", "scope")
    references = t.where("id % 5 = 0").select("scope", "id", "at", (F.col("usd") * 200).alias("liquidity"), "trader")
    reviews = references.select("id", (F.col("at") + F.when(F.col("id") % 4 > 0, F.col("id") % 4 * HOUR).otherwise(0)).alias("checked_at"), F.lit(100.0).alias("order_usd"), (F.col("id") % 7).cast("double").alias("impact"))
    later = joins.range_join(references.select("trader", "at", "id"), t.select("trader", "at", "usd"), ["trader"], 4 * HOUR)
    samples = later.select("id", F.col("r.at").alias("at"), (F.col("r.usd") * 200).alias("liquidity"))
    sent = t.select("scope", F.col("trader").cast("string").alias("token"), "id", "at")
    found = rollout.evidence(t.groupBy("scope").agg(F.min("at").alias("started_at")), t.select("scope", "at"), references.drop("trader"), reviews, samples, sent, UNTIL, RULES)
    return found.select("scope", "slots", "widest", "passed", "total", F.array_join("blockers", ",").alias("blockers"))
