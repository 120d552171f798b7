"""Queries over trades and bars."""

from __future__ import annotations

from pyspark.sql import functions as F

from driftline.operators import flow, joins
from driftline.operators import timeseries as ts
from driftline.plans.registry import Registry
from driftline.plans.views import BAR, BARS, HOUR, TRADES, bars, bars_sql, trades

reg = Registry()
K = ["chain"]
NOW = 1_706_000_000_000
W = "WINDOW k AS (PARTITION BY chain ORDER BY at)"


def r6(c):
    return F.round(c, 6)


@reg.query(f"WITH {TRADES} SELECT id, at, trader, chain, pool, tx, side, usd, price FROM trades WHERE usd > 0 AND at > 0")
def trade_normalize(spark, d):
    return trades(spark, d).where("usd > 0 AND at > 0")


@reg.query(f"""WITH {TRADES} SELECT id, sha256('["' || concat_ws('","', chain, pool, tx, trader, side, regexp_replace(usd::DECIMAL(38,10)::VARCHAR, '\\.?0+$', '')) || '"]') AS trade_id FROM trades""")
def trade_id_hash(spark, d):
    return trades(spark, d).select("id", flow.trade_id().alias("trade_id"))


@reg.query(f"WITH {TRADES} SELECT tx, max(at) AS at, arg_max(id, at * 1000000 + id) AS id FROM trades GROUP BY tx")
def trade_dedup(spark, d):
    t = trades(spark, d).select("tx", "at", "id", (F.col("at") * 1000000 + F.col("id")).alias("o"))
    return flow.dedup_last(t, "tx", "o").select("tx", "at", "id")


@reg.query(f"WITH {TRADES} SELECT id, at FROM trades WHERE at > 0 AND at <= {NOW} + 5000")
def future_late_filter(spark, d):
    return trades(spark, d).where(flow.timely(NOW)).select("id", "at")


FLOW_SQL = """c AS (SELECT chain, count(DISTINCT CASE WHEN side = 'buy' THEN tx END) AS buys, count(DISTINCT CASE WHEN side = 'sell' THEN tx END) AS sells FROM w GROUP BY chain),
p AS (SELECT chain, trader, sum(usd::DECIMAL(18,2)) FILTER (side = 'buy') AS b, sum(usd::DECIMAL(18,2)) FILTER (side = 'sell') AS s FROM w GROUP BY ALL),
q AS (SELECT chain, coalesce(sum(b), 0)::DOUBLE AS buy_usd, coalesce(sum(s), 0)::DOUBLE AS sell_usd, count(b) AS buyers, count(s) AS sellers, coalesce(max(b), 0)::DOUBLE AS largest,
      coalesce(list_sum(list_slice(list_reverse_sort(list(b) FILTER (b IS NOT NULL)), 1, 5)), 0)::DOUBLE AS top5 FROM p GROUP BY chain)
SELECT chain, buys, sells, buy_usd, sell_usd, buyers, sellers, round(CASE WHEN sells > 0 THEN buys / sells WHEN buys > 0 THEN 1e6 ELSE 0 END, 6) AS count_ratio,
  round(CASE WHEN sell_usd > 0 THEN buy_usd / sell_usd WHEN buy_usd > 0 THEN 1e6 ELSE 0 END, 6) AS usd_ratio,
  round(CASE WHEN buy_usd > 0 THEN largest / buy_usd ELSE 1 END, 6) AS top_buyer_share, round(CASE WHEN buy_usd > 0 THEN top5 / buy_usd ELSE 1 END, 6) AS top5_share
FROM c JOIN q USING (chain)"""


def rounded(df, *columns):
    return df.withColumns({c: r6(F.col(c)) for c in columns})


@reg.query(f"WITH {TRADES}, w AS (SELECT * FROM trades WHERE at > {NOW} - {240 * HOUR} AND at <= {NOW}), {FLOW_SQL}")
def flow_windows(spark, d):
    return rounded(flow.flow(flow.window_of(trades(spark, d), NOW, 240 * HOUR), K), "count_ratio", "usd_ratio", "top_buyer_share", "top5_share")


@reg.query(f"WITH {TRADES}, w AS (SELECT * FROM trades), {FLOW_SQL}")
def flow_shares(spark, d):
    return rounded(flow.flow(trades(spark, d), K), "count_ratio", "usd_ratio", "top_buyer_share", "top5_share")


def part_sql(k):
    return f"coalesce(sum(usd::DECIMAL(18,2)) FILTER ({NOW} - at >= {k * 24 * HOUR} AND {NOW} - at < {(k + 1) * 24 * HOUR}), 0)::DOUBLE"


@reg.query(f"WITH {TRADES} SELECT chain, {part_sql(0)} AS current, {part_sql(1)} AS previous, {part_sql(2)} AS preceding FROM trades WHERE {NOW} - at >= 0 AND {NOW} - at < {72 * HOUR} GROUP BY chain")
def adjacent_windows(spark, d):
    return flow.adjacent(trades(spark, d), K, NOW, 24 * HOUR)


@reg.query(f"WITH {TRADES} SELECT chain, pool, count(*) AS trades, round(CASE WHEN count(*) >= 2 THEN (last(price ORDER BY at, id) / first(price ORDER BY at, id) - 1) * 100 END, 6) AS change FROM trades GROUP BY chain, pool")
def price_change(spark, d):
    return rounded(flow.price_change(trades(spark, d), ["chain", "pool"]), "change")


@reg.query(f"WITH {TRADES}, b AS (SELECT chain, at // {HOUR} AS bar, sum(usd::DECIMAL(18,2)) AS v FROM trades GROUP BY ALL) SELECT chain, round(max(v)::DOUBLE / sum(v)::DOUBLE, 6) AS share FROM b GROUP BY chain")
def largest_bar_share(spark, d):
    return rounded(flow.largest_bar_share(trades(spark, d), K, HOUR), "share")


@reg.query(f"WITH {bars_sql(60_000)} SELECT * FROM bars")
def minute_candles(spark, d):
    return bars(spark, d, 60_000)


@reg.query(f"WITH {BARS} SELECT * FROM bars WHERE at + {BAR} <= {NOW} AND low > 0")
def candle_validate(spark, d):
    return ts.valid_bars(bars(spark, d), BAR, NOW)


@reg.query(f"""WITH {bars_sql(2 * HOUR)}, n AS (SELECT *, row_number() OVER (PARTITION BY chain ORDER BY at DESC) - 1 AS back, max(at) OVER (PARTITION BY chain) AS newest FROM bars)
SELECT chain, at, open, high, low, close, volume, trades FROM n WHERE at = newest - back * {2 * HOUR}""")
def contiguous_tail(spark, d):
    return ts.contiguous_tail(bars(spark, d, 2 * HOUR), K, 2 * HOUR)


def ema_sql(span, seeded):
    seed = f"SELECT chain, rn, (SELECT avg(close) FROM n m WHERE m.chain = n.chain AND m.rn <= {span}) AS ema FROM n WHERE rn = {span}" if seeded else "SELECT chain, rn, close AS ema FROM n WHERE rn = 1"
    return f"""WITH RECURSIVE {BARS}, n AS (SELECT *, row_number() OVER (PARTITION BY chain ORDER BY at) AS rn FROM bars),
e AS ({seed} UNION ALL SELECT n.chain, n.rn, (1 - 2.0::DOUBLE / {span + 1}) * e.ema + 2.0::DOUBLE / {span + 1} * n.close FROM e JOIN n ON n.chain = e.chain AND n.rn = e.rn + 1)
SELECT chain, at, round(ema, 6) AS ema FROM n LEFT JOIN e USING (chain, rn)"""


@reg.query(ema_sql(9, False))
def ema_first_close(spark, d):
    return ts.ema(bars(spark, d), K, {"ema": 9}).select("chain", "at", r6("ema").alias("ema"))


@reg.query(ema_sql(21, True))
def ema_sma_seed(spark, d):
    return ts.ema(bars(spark, d), K, {"ema": 21}, seeded=True).select("chain", "at", r6("ema").alias("ema"))


@reg.query(f"""WITH {BARS}, n AS (SELECT *, row_number() OVER k AS rn, avg(close) OVER (PARTITION BY chain ORDER BY at ROWS 49 PRECEDING) AS s, avg(volume) OVER (PARTITION BY chain ORDER BY at ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) AS m FROM bars {W})
SELECT chain, at, round(CASE WHEN rn >= 50 THEN s END, 6) AS sma50, round(CASE WHEN rn >= 21 AND m > 0 THEN volume / m END, 6) AS volume_ratio FROM n""")
def sma_volume_ratio(spark, d):
    return bars(spark, d).select("chain", "at", r6(ts.sma("close", K, 50)).alias("sma50"), r6(ts.volume_ratio(K)).alias("volume_ratio"))


@reg.query(f"""WITH {BARS}, t AS (SELECT chain, at, row_number() OVER k AS rn, greatest(high - low, abs(high - lag(close) OVER k), abs(low - lag(close) OVER k)) AS tr FROM bars {W})
SELECT chain, at, round(CASE WHEN rn >= 15 THEN avg(tr) OVER (PARTITION BY chain ORDER BY at ROWS 13 PRECEDING) END, 6) AS atr FROM t""")
def atr14(spark, d):
    return ts.atr(bars(spark, d), K).select("chain", "at", r6("atr").alias("atr"))


@reg.query(f"WITH {BARS}, p AS (SELECT *, max(high) OVER (PARTITION BY chain ORDER BY at ROWS BETWEEN 288 PRECEDING AND 1 PRECEDING) AS peak FROM bars) SELECT chain, at, peak, round((peak - close) / peak * 100, 6) AS drawdown FROM p")
def prior_peak_drawdown(spark, d):
    return bars(spark, d).select("chain", "at", ts.prior_peak(K).alias("peak"), r6(ts.drawdown(K)).alias("drawdown"))


@reg.query(f"WITH {BARS} SELECT chain, at, round((close - lag(close, 3) OVER k) / lag(close, 3) OVER k * 100, 6) AS slope FROM bars {W}")
def close_slope(spark, d):
    return bars(spark, d).select("chain", "at", r6(ts.slope("close", K, 3)).alias("slope"))


@reg.query(f"""WITH {BARS} SELECT chain, at, round(CASE WHEN high > low THEN abs(close - open) / (high - low) * 100 ELSE 0 END, 6) AS body_pct, round(CASE WHEN high > low THEN (high - greatest(open, close)) / (high - low) * 100 ELSE 0 END, 6) AS upper_wick_pct,
round(CASE WHEN high > low THEN (least(open, close) - low) / (high - low) * 100 ELSE 0 END, 6) AS lower_wick_pct, round(CASE WHEN high > low THEN (close - low) / (high - low) * 100 ELSE 0 END, 6) AS close_position FROM bars""")
def candle_features(spark, d):
    f = ts.body_features(bars(spark, d))
    return rounded(f.select("chain", "at", "body_pct", "upper_wick_pct", "lower_wick_pct", "close_position"), "body_pct", "upper_wick_pct", "lower_wick_pct", "close_position")


PIVOT_SQL = f"""{BARS}, n AS (SELECT chain, at, low, row_number() OVER k AS i, min(low) OVER (PARTITION BY chain ORDER BY at ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS l,
min(low) OVER (PARTITION BY chain ORDER BY at ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING) AS r, count(*) OVER (PARTITION BY chain ORDER BY at ROWS BETWEEN 1 FOLLOWING AND 12 FOLLOWING) AS f FROM bars {W}),
v AS (SELECT chain, at, low, i FROM n WHERE i >= 4 AND f >= 12 AND low < l AND low < r)"""


@reg.query(f"WITH {PIVOT_SQL} SELECT chain, at, low FROM v")
def pivot_lows(spark, d):
    return bars(spark, d).select("chain", "at", "low", ts.pivot_lows(K).alias("p")).where("p").drop("p")


@reg.query(f"WITH {PIVOT_SQL} SELECT v.chain, v.at, v.low, count(w.i) AS peers FROM v LEFT JOIN v w ON w.chain = v.chain AND w.i < v.i AND w.i >= v.i - 288 AND abs(w.low / v.low - 1) <= 0.04 GROUP BY ALL")
def pivot_peers(spark, d):
    return ts.pivot_peers(bars(spark, d), K)


@reg.query(f"""WITH {BARS}, m AS (SELECT chain, at, row_number() OVER k AS rn, min(low) OVER (PARTITION BY chain ORDER BY at ROWS BETWEEN 8 PRECEDING AND 6 PRECEDING) AS a, min(low) OVER (PARTITION BY chain ORDER BY at ROWS BETWEEN 5 PRECEDING AND 3 PRECEDING) AS b,
min(low) OVER (PARTITION BY chain ORDER BY at ROWS 2 PRECEDING) AS c FROM bars {W}) SELECT chain, at, CASE WHEN rn >= 9 THEN a < b AND b < c END AS higher FROM m""")
def higher_lows(spark, d):
    return bars(spark, d).select("chain", "at", ts.higher_lows(K).alias("higher"))


@reg.query(f"WITH {BARS}, p AS (SELECT *, row_number() OVER k AS rn, max(high) OVER (PARTITION BY chain ORDER BY at ROWS 9 PRECEDING) AS peak FROM bars {W}) SELECT chain, at, round(CASE WHEN rn >= 10 THEN (peak - close) / peak END, 6) AS pullback FROM p")
def pullback(spark, d):
    return bars(spark, d).select("chain", "at", r6(ts.pullback(K)).alias("pullback"))


@reg.query(f"WITH {TRADES}, g AS (SELECT chain, at - lag(at) OVER (PARTITION BY chain ORDER BY at) AS gap FROM trades) SELECT chain, max(gap) AS largest, count(*) FILTER (gap > {HOUR}) AS over FROM g GROUP BY chain")
def observation_gaps(spark, d):
    g = trades(spark, d).select("chain", ts.largest_gap("at", K).alias("gap"))
    return g.groupBy("chain").agg(F.max("gap").alias("largest"), F.count_if(F.col("gap") > HOUR).alias("over"))


@reg.query(f"WITH {TRADES}, l AS (SELECT id, chain, at - {HOUR} AS t FROM trades), m AS (SELECT chain, at, max(usd) AS usd FROM trades GROUP BY ALL) SELECT l.id, m.usd AS prior FROM l ASOF LEFT JOIN m ON l.chain = m.chain AND l.t >= m.at")
def asof_prior(spark, d):
    t = trades(spark, d)
    right = t.select("chain", "at", F.col("usd").alias("prior"))
    return joins.asof_join(t.select("id", "chain", "at"), right, K, ["prior"], lag=HOUR).select("id", "prior")


@reg.query(f"WITH {TRADES} SELECT a.id, first(b.price ORDER BY b.at, b.price) AS price FROM trades a JOIN trades b ON a.chain = b.chain AND b.at >= a.at + {HOUR} AND b.at < a.at + {3 * HOUR} GROUP BY a.id")
def asof_forward(spark, d):
    t = trades(spark, d)
    return joins.first_at_or_after(t.select("id", "chain", (F.col("at") + HOUR).alias("at")), t.select("chain", "at", "price"), K, "id", "price", 2 * HOUR)


@reg.query(f"WITH {TRADES}, s AS (SELECT chain, pool, at, usd FROM trades WHERE side = 'sell') SELECT a.id, first(s.usd ORDER BY abs(s.at - a.at), s.at, s.usd) AS usd FROM trades a JOIN s ON a.chain = s.chain AND a.pool = s.pool AND abs(s.at - a.at) <= {HOUR} WHERE a.side = 'buy' GROUP BY a.id")
def nearest_sample(spark, d):
    t = trades(spark, d)
    return joins.nearest(t.where("side = 'buy'").select("id", "chain", "pool", "at"), t.where("side = 'sell'").select("chain", "pool", "at", "usd"), ["chain", "pool"], "id", "usd", HOUR)


@reg.query(f"WITH {BARS} SELECT a.chain, a.at, count(*) AS n, max(b.high) AS high, min(b.low) AS low FROM bars a JOIN bars b ON a.chain = b.chain AND b.at >= a.at AND b.at < a.at + {4 * BAR} GROUP BY ALL")
def forward_path_range(spark, d):
    b = bars(spark, d)
    pairs = joins.range_join(b.select("chain", "at"), b, K, 4 * BAR)
    return pairs.groupBy("chain", "at").agg(F.count(F.lit(1)).alias("n"), F.max("r.high").alias("high"), F.min("r.low").alias("low"))


@reg.query(f"WITH {TRADES}, g AS (SELECT chain, at AS since, lead(at) OVER (PARTITION BY chain ORDER BY at) AS until FROM trades) SELECT id FROM trades t WHERE EXISTS (SELECT 1 FROM g WHERE g.chain = t.chain AND until - since > {HOUR} AND since < at + 600000 AND until > at)")
def gap_overlap(spark, d):
    t = trades(spark, d)
    gaps = t.select("chain", F.col("at").alias("since"), F.lead("at").over(ts.ordered(K)).alias("until")).where(F.col("until") - F.col("since") > HOUR)
    return joins.overlaps(t.select("id", "chain", F.col("at").alias("start"), (F.col("at") + 600_000).alias("stop")), gaps, "chain", "id", 4 * HOUR)


@reg.query(f"WITH {BARS}, s AS (SELECT chain, at, close, lead(close) OVER k AS next_close, lead(at) OVER k AS n FROM bars {W}) SELECT chain, at, close, CASE WHEN n = at + {BAR} THEN next_close END AS next_close FROM s")
def shifted_bars(spark, d):
    b = bars(spark, d)
    after = b.select("chain", (F.col("at") - BAR).alias("at"), F.col("close").alias("next_close"))
    return b.select("chain", "at", "close").join(after, ["chain", "at"], "left")


@reg.query(f"WITH {TRADES} SELECT DISTINCT trader, chain FROM trades t WHERE EXISTS (SELECT 1 FROM trades u WHERE u.trader = t.trader AND u.at > {NOW} - {48 * HOUR} AND u.side = 'buy')")
def semi_recent(spark, d):
    t = trades(spark, d)
    recent = t.where((F.col("at") > NOW - 48 * HOUR) & (F.col("side") == "buy")).select("trader")
    return t.join(recent, "trader", "left_semi").select("trader", "chain").distinct()


@reg.query(f"WITH {TRADES} SELECT id FROM trades t WHERE EXISTS (SELECT 1 FROM trades u WHERE u.trader = t.trader AND u.id <> t.id AND abs(u.at - t.at) < {HOUR})")
def duplicate_band(spark, d):
    return joins.duplicates_within(trades(spark, d), "trader", "id", HOUR)


@reg.query(f"WITH {TRADES} SELECT trader, min(at) AS first_seen, max(at) AS last_seen FROM trades GROUP BY trader")
def first_seen_upsert(spark, d):
    from driftline.operators import ledger

    t = trades(spark, d)
    old, new = t.where(F.col("id") % 2 == 0), t.where(F.col("id") % 2 == 1)
    return ledger.merge_seen(ledger.seen(old, ["trader"]), ledger.seen(new, ["trader"]), ["trader"])
