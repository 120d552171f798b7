"""Queries over patterns, labels, folds, models and streams."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from driftline.operators import intervals, labels, models, montecarlo, normalize, resample, screening, simulate, stats, validation
from driftline.operators import timeseries as ts
from driftline.plans.registry import Registry
from driftline.plans.studies import PATHS, path_rows, r6
from driftline.plans.views import BAR, BARS, FILLS, HOUR, TRADES, bars, bars_sql, fills, millis, table, trades
from driftline.streaming import streams

reg = Registry()
K = ["chain"]

# ---- parsing

@reg.query("SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k, CASE WHEN TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) > 0 THEN TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) END AS positive, json_extract_string(props, '$.missing') AS missing FROM events")
def json_props(spark, d):
    at = lambda p: F.get_json_object("props", p)
    return table(spark, d, "events").select("event_id", normalize.number(at("$.k")).alias("k"), normalize.positive(at("$.k")).alias("positive"), at("$.missing").alias("missing"))


@reg.query("""WITH a AS (SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'base' ELSE 'solana' END AS chain, CASE WHEN c_custkey % 3 = 0 THEN '0x' || upper(md5(c_name)) || 'ABCDEF01' ELSE md5(c_name) END AS raw FROM customer)
SELECT c_custkey, CASE WHEN chain = 'solana' THEN CASE WHEN regexp_matches(raw, '^[1-9A-HJ-NP-Za-km-z]{32,44}$') THEN raw END WHEN regexp_matches(raw, '^0x[0-9a-fA-F]{40}$') THEN lower(raw) END AS address FROM a""")
def address_canonical(spark, d):
    h = F.md5(F.col("c_name").cast("binary"))
    raw = F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("0x"), F.upper(h), F.lit("ABCDEF01"))).otherwise(h)
    return table(spark, d, "customer").select("c_custkey", normalize.address(F.when(F.col("c_custkey") % 2 == 0, "base").otherwise("solana"), raw).alias("address"))


@reg.query("WITH l AS (SELECT l_orderkey, sum(CASE WHEN l_returnflag = 'R' THEN -l_quantity ELSE l_quantity END) AS q, sum(CASE WHEN l_linestatus = 'F' THEN -l_linenumber ELSE l_linenumber END) AS t FROM lineitem GROUP BY 1) SELECT l_orderkey, CASE WHEN q < 0 AND t > 0 THEN 'buy' WHEN q > 0 AND t < 0 THEN 'sell' END AS side FROM l")
def swap_classification(spark, d):
    sign = lambda c, v, x: F.sum(F.when(F.col(c) == v, -F.col(x)).otherwise(F.col(x)))
    g = table(spark, d, "lineitem").groupBy("l_orderkey").agg(sign("l_returnflag", "R", "l_quantity").alias("q"), sign("l_linestatus", "F", "l_linenumber").alias("t"))
    return g.select("l_orderkey", normalize.swap_side(F.col("q"), F.col("t")).alias("side"))


# ---- pattern

@reg.query(f"""WITH {BARS}, f AS (SELECT *, row_number() OVER w AS rn, avg(volume) OVER (PARTITION BY chain ORDER BY at ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) AS m, lag(close) OVER w AS pc FROM bars WINDOW w AS (PARTITION BY chain ORDER BY at))
SELECT chain, at, close > open AS up, rn >= 21 AND volume >= 1.2 * m AS active, high > low AND (close - low) / (high - low) >= 0.65 AS strong, coalesce(close > pc, false) AS rising FROM f""")
def signal_conditions(spark, d):
    b = bars(spark, d)
    ratio, before = ts.volume_ratio(K), F.lag("close").over(ts.ordered(K))
    mean = ts.framed(F.avg, "volume", K, -20, -1)
    span = F.col("high") - F.col("low")
    strong = F.when(span > 0, (F.col("close") - F.col("low")) / span >= 0.65).otherwise(F.lit(False))
    return b.select("chain", "at", (F.col("close") > F.col("open")).alias("up"), (ts.full(K, 21) & (F.col("volume") >= 1.2 * mean)).alias("active"), strong.alias("strong"), F.coalesce(F.col("close") > before, F.lit(False)).alias("rising"))


# ---- labels

HITS = f"""{PATHS}, h AS (SELECT id, min(bar + {BAR}) FILTER (low <= entry * 0.5) AS stop_at, min(bar + {BAR}) FILTER (high >= entry * 1.5) AS target_at, count(*) >= 8 AS complete FROM paths GROUP BY id),
hits AS (SELECT *, CASE WHEN stop_at IS NULL AND target_at IS NULL THEN NULL WHEN stop_at = target_at THEN 'ambiguous' WHEN target_at IS NULL OR stop_at < target_at THEN 'stop' ELSE 'target' END AS first FROM h)"""


@reg.query(f"WITH {HITS} SELECT id, stop_at, target_at, \"first\", complete FROM hits".replace(" AS first FROM", ' AS "first" FROM'))
def research_label(spark, d):
    return labels.first_hit(path_rows(spark, d), 0.5, 1.5, BAR, 8)


@reg.query((f"WITH {HITS} SELECT id, CASE WHEN \"first\" = 'target' THEN 1 WHEN \"first\" = 'stop' THEN 0 END AS y, coalesce(least(stop_at, target_at), CASE WHEN complete THEN string_split(id, '|')[2]::BIGINT + {8 * BAR} END) AS resolved_at FROM hits").replace(" AS first FROM", ' AS "first" FROM'))
def label_source(spark, d):
    hits = labels.first_hit(path_rows(spark, d), 0.5, 1.5, BAR, 8)
    end = F.split("id", "\\|")[1].cast("long") + 8 * BAR
    y, at = labels.label(F.col("first"), F.least("stop_at", "target_at"), end, F.col("complete"))
    return hits.select("id", y.alias("y"), at.alias("resolved_at"))


@reg.query(f"WITH {PATHS} SELECT id, " + ", ".join(f"round(max((close / entry - 1) * 100) FILTER (i = {n - 1}), 6) AS r{n}" for n in (1, 2, 4, 8)) + " FROM paths GROUP BY id")
def horizon_returns(spark, d):
    return r6(labels.horizon_returns(path_rows(spark, d), [1, 2, 4, 8]), "r1", "r2", "r4", "r8")


@reg.query(f"""WITH {TRADES}, g AS (SELECT trader, first(price ORDER BY at, id) AS e, first(usd * 10 ORDER BY at, id) AS l0, last(price ORDER BY at, id) AS l, min(usd * 10) AS least, max(price) AS hi, min(price) AS lo FROM trades GROUP BY trader)
SELECT trader, least <= greatest(1, l0 * 0.01) AS rug, round(CASE WHEN least <= greatest(1, l0 * 0.01) THEN -100 ELSE (l / e - 1) * 100 END, 6) AS ret, round((hi / e - 1) * 100, 6) AS mfe, round(CASE WHEN least <= greatest(1, l0 * 0.01) THEN -100 ELSE (lo / e - 1) * 100 END, 6) AS mae FROM g""")
def rug_outcome(spark, d):
    s = trades(spark, d).select("trader", "at", "id", "price", (F.col("usd") * 10).alias("liquidity"))
    return r6(labels.rug_outcome(s, "trader", 1.0), "ret", "mfe", "mae")


# ---- folds and models

def frame(spark, d):
    """id, grp, at, resolved_at, y and three features of each order."""
    o = table(spark, d, "orders")
    at = millis("o_orderdate")
    return o.select(
        F.col("o_orderkey").alias("id"), F.concat(F.lit("g"), F.date_format("o_orderdate", "yyyyMM"), F.lit("-"), (F.col("o_custkey") % 3).cast("string")).alias("grp"), at.alias("at"), (at + 72 * HOUR).alias("resolved_at"),
        (F.col("o_totalprice") > 250_000).cast("int").alias("y"), F.col("o_totalprice").alias("price"), (F.col("o_custkey") % 17).cast("double").alias("f1"), (F.col("o_orderkey") * 37 % 101).cast("double").alias("f2"),
    )


@reg.query("""WITH o AS (SELECT 'g' || strftime(o_orderdate, '%Y%m') || '-' || (o_custkey % 3) AS grp, epoch_us(o_orderdate) // 1000 AS at FROM orders), s AS (SELECT grp, min(at) AS a, max(at) AS b, count(*) AS n FROM o GROUP BY grp),
r AS (SELECT *, row_number() OVER (ORDER BY a, b, grp) - 1 AS i, count(*) OVER () AS g FROM s)
SELECT grp, n AS rows, (CASE WHEN i < (g % 6) * (g // 6 + 1) THEN i // (g // 6 + 1) ELSE g % 6 + (i - (g % 6) * (g // 6 + 1)) // (g // 6) END)::INT AS block FROM r""".replace(" AS rows", ' AS "rows"'))
def fold_blocks(spark, d):
    return validation.blocks(frame(spark, d), "grp", "at", 6).groupBy("grp", "block").agg(F.count(F.lit(1)).alias("rows"))


FOLDS = f"""fr AS (SELECT o_orderkey AS id, 'g' || strftime(o_orderdate, '%Y%m') || '-' || (o_custkey % 3) AS grp, epoch_us(o_orderdate) // 1000 AS at, epoch_us(o_orderdate) // 1000 + {72 * HOUR} AS resolved_at, (o_totalprice > 250000)::INT AS y FROM orders),
sp AS (SELECT grp, min(at) AS a, max(at) AS b FROM fr GROUP BY grp), rk AS (SELECT grp, row_number() OVER (ORDER BY a, b, grp) - 1 AS i, count(*) OVER () AS g FROM sp),
bl AS (SELECT grp, (CASE WHEN i < (g % 6) * (g // 6 + 1) THEN i // (g // 6 + 1) ELSE g % 6 + (i - (g % 6) * (g // 6 + 1)) // (g // 6) END)::INT AS block FROM rk),
pl AS (SELECT * FROM fr JOIN bl USING (grp)), bo AS (SELECT block, min(at) AS start, max(at) AS stop FROM pl GROUP BY block),
members AS (SELECT f.block AS fold, p.id, p.grp, p.at, p.resolved_at, f.start, CASE WHEN p.block = f.block THEN 'test' ELSE 'train' END AS role FROM pl p, bo f WHERE f.block > 0 AND (p.block = f.block OR (p.block < f.block AND p.at < f.start - {24 * HOUR} AND p.resolved_at < f.start
  AND NOT EXISTS (SELECT 1 FROM bo e WHERE e.block > 0 AND e.block < f.block AND p.at > e.stop AND p.at <= e.stop + {24 * HOUR}))))"""


@reg.query(f"WITH {FOLDS} SELECT fold, role, count(*) AS n FROM members GROUP BY fold, role")
def walk_forward_folds(spark, d):
    members, _ = validation.walk_forward(frame(spark, d), embargo=24 * HOUR, least=20)
    return members.groupBy("fold", "role").agg(F.count(F.lit(1)).alias("n"))


@reg.query(f"""WITH {FOLDS}, sd AS (SELECT fold, count(*) FILTER (sides > 1) AS shared_groups FROM (SELECT fold, grp, count(DISTINCT role) AS sides FROM members GROUP BY fold, grp) GROUP BY fold),
st AS (SELECT fold, min(at) FILTER (role = 'test') AS begin FROM members GROUP BY fold)
SELECT fold, count(*) FILTER (role = 'train') AS n_train, count(*) FILTER (role = 'test') AS n_test, any_value(shared_groups) AS shared_groups, count(*) FILTER (role = 'train' AND resolved_at >= begin) AS unpurged, count(*) FILTER (role = 'train' AND at >= begin - {24 * HOUR}) AS embargoed,
  max(at) FILTER (role = 'train') < min(at) FILTER (role = 'test') AS in_order FROM members JOIN sd USING (fold) JOIN st USING (fold) GROUP BY fold""")
def fold_validation(spark, d):
    f = frame(spark, d)
    members, _ = validation.walk_forward(f, embargo=24 * HOUR, least=20)
    return validation.violations(members, f, embargo=24 * HOUR)


@reg.query(f"""WITH {FOLDS}, gr AS (SELECT o_orderkey AS id, 'r' || r AS rule, (o_orderkey * 7919 + r * 104729) % 401 - 200 AS net FROM orders, range(6) g(r)),
sd AS (SELECT fold, rule, avg(net) FILTER (role = 'train') AS train_mean, count(*) FILTER (role = 'train') AS n_train, avg(net) FILTER (role = 'test') AS test_mean, count(*) FILTER (role = 'test') AS n_test FROM members JOIN gr USING (id) GROUP BY fold, rule),
k AS (SELECT *, row_number() OVER (PARTITION BY fold ORDER BY train_mean DESC, rule) AS place FROM sd WHERE n_train >= 10) SELECT fold, rule, round(train_mean, 6) AS train_mean, n_train, round(test_mean, 6) AS test_mean, n_test, round(train_mean - test_mean, 6) AS optimism FROM k WHERE place = 1""")
def nested_rule_selection(spark, d):
    """The rule chosen in training, what it then makes in the test, and how much the training flattered it."""
    f = frame(spark, d)
    members, _ = validation.walk_forward(f, embargo=24 * HOUR, least=20)
    grid = f.select("id", F.explode(F.sequence(F.lit(0), F.lit(5))).alias("r")).select("id", F.concat(F.lit("r"), F.col("r").cast("string")).alias("rule"), (F.pmod(F.col("id") * 7919 + F.col("r") * 104729, F.lit(401)) - 200).alias("net"))
    chosen = validation.nested_choice(members, grid)
    return r6(chosen.select("*", (F.col("train_mean") - F.col("test_mean")).alias("optimism")), "train_mean", "test_mean", "optimism")


def oof(spark, d, kind):
    f = frame(spark, d)
    members, folds = validation.walk_forward(f, embargo=24 * HOUR, least=20)
    return models.out_of_fold(f, members, ["f1", "f2"], [x.number for x in folds], kind)


@reg.query()
def logistic_oof(spark, d):
    return oof(spark, d, "logistic")


@reg.query()
def boosting_oof(spark, d):
    return oof(spark, d, "boosting")


@reg.query()
def calibrated_oof(spark, d):
    """Out-of-fold baseline, logistic, and both calibrated by inner splits, in one frame."""
    f = frame(spark, d)
    members, folds = validation.walk_forward(f, embargo=24 * HOUR, least=20)
    return models.logistic_frame(f, members, ["f1", "f2"], [x.number for x in folds])


@reg.query()
def coefficient_intervals(spark, d):
    """Coefficients of the logistic regression with intervals by resampled days."""
    return intervals.coefficients(frame(spark, d).select("y", F.expr(f"at div {24 * HOUR}").alias("day"), "f1", "f2"), ["f1", "f2"], reps=200)


PAIR = f"""{FILLS}, sc AS (SELECT day, (net_bp > 0)::INT AS y, m.model, CASE m.model WHEN 'l' THEN (o * 37 % 101 + 1) / 103.0::DOUBLE ELSE (n * 13 % 17 + 1) / 19.0::DOUBLE END AS p FROM fills, (SELECT unnest(['l', 'r']) AS model) m),
dd AS (SELECT day, row_number() OVER (ORDER BY day) - 1 AS i, count(*) OVER () AS k FROM (SELECT DISTINCT day FROM fills)),
wt AS (SELECT rep, i, count(*) AS w FROM (SELECT rep, ({resample.draw_sql(1, 'rep', 'i')}) % k AS i FROM dd, range(200) g(rep)) GROUP BY ALL UNION ALL SELECT -1, i, 1 FROM dd),
cn AS (SELECT model, p, i, sum(y) AS pos, count(*) - sum(y) AS neg FROM sc JOIN dd USING (day) GROUP BY ALL), gs AS (SELECT model, rep, p, sum(w * pos) AS pos, sum(w * neg) AS neg FROM cn JOIN wt USING (i) GROUP BY ALL),
hs AS (SELECT *, sum(pos) OVER v AS tp, sum(neg) OVER v AS fp, sum(pos) OVER (PARTITION BY model, rep) AS ap, sum(neg) OVER (PARTITION BY model, rep) AS an FROM gs WINDOW v AS (PARTITION BY model, rep ORDER BY p DESC)),
rp AS (SELECT model, rep, sum(-(pos * ln(p) + neg * ln(1 - p))) / sum(pos + neg) AS log_loss, sum(pos * (1 - p) ** 2 + neg * p * p) / sum(pos + neg) AS brier, sum(pos * (an - fp + neg / 2.0::DOUBLE)) / (any_value(ap)::DOUBLE * any_value(an)) AS roc_auc, sum(CASE WHEN pos > 0 THEN pos * tp / (tp + fp)::DOUBLE END) / any_value(ap) AS pr_auc FROM hs GROUP BY ALL),
lg AS (UNPIVOT rp ON log_loss, brier, roc_auc, pr_auc INTO NAME metric VALUE value)"""


def predictions(spark, d):
    return fills(spark, d).select("day", (F.col("net_bp") > 0).cast("int").alias("y"), ((F.col("o") * 37 % 101 + 1) / 103.0).alias("l"), ((F.col("n") * 13 % 17 + 1) / 19.0).alias("r"))


@reg.query(f"WITH {PAIR} SELECT model, metric, round(max(value) FILTER (rep = -1), 6) AS estimate, round(quantile_cont(value, 0.025) FILTER (rep >= 0), 6) AS low, round(quantile_cont(value, 0.975) FILTER (rep >= 0), 6) AS high FROM lg GROUP BY ALL")
def metric_intervals(spark, d):
    """Log loss, Brier, ROC AUC and average precision of two predictions, with intervals by resampled days."""
    rows = predictions(spark, d).select("y", "day", F.explode(F.create_map(F.lit("l"), "l", F.lit("r"), "r")).alias("model", "p"))
    return r6(intervals.metric_intervals(rows, 200), "estimate", "low", "high")


@reg.query(f"""WITH {PAIR}, df AS (SELECT metric, rep, max(value) FILTER (model = 'l') AS a, max(value) FILTER (model = 'r') AS b FROM lg GROUP BY ALL)
SELECT metric, round(max(a) FILTER (rep = -1), 6) AS "left", round(max(b) FILTER (rep = -1), 6) AS "right", round(max(a - b) FILTER (rep = -1), 6) AS difference, round(quantile_cont(a - b, 0.025) FILTER (rep >= 0), 6) AS low, round(quantile_cont(a - b, 0.975) FILTER (rep >= 0), 6) AS high,
  (SELECT count(*) FROM dd) AS days, (SELECT count(*) FROM fills) AS "rows" FROM df GROUP BY metric""")
def paired_metric_differences(spark, d):
    """Both predictions' metrics over the same resampled days, and their difference."""
    return r6(intervals.paired_differences(predictions(spark, d), "l", "r", 200), "left", "right", "difference", "low", "high")


@reg.query()
def isotonic_calibration(spark, d):
    return models.isotonic(table(spark, d, "labels").select(F.col("doc_id").alias("id"), F.col("toxic").alias("y"), ((F.col("doc_id") * 37 % 101 + 1) / 103.0).alias("p")))


@reg.query(f"""WITH {bars_sql(HOUR)}, m AS (SELECT chain, at, trades AS buyers FROM bars), p AS (SELECT a.chain, a.at, a.buyers, b.buyers AS before FROM m a ASOF LEFT JOIN m b ON a.chain = b.chain AND a.at - {6 * HOUR} >= b.at) SELECT chain, at, buyers - before AS acceleration FROM p""")
def flow_features(spark, d):
    from driftline.operators import joins

    m = bars(spark, d, HOUR).select("chain", "at", F.col("trades").alias("buyers"))
    p = joins.asof_join(m, m.select("chain", "at", F.col("buyers").alias("before")), K, ["before"], lag=6 * HOUR)
    return p.select("chain", "at", (F.col("buyers") - F.col("before")).alias("acceleration"))


# ---- Monte-Carlo and accounts

@reg.query()
def bankroll_monte_carlo(spark, d):
    """Each rule's daily mean returns, bet at fixed fractions."""
    days = fills(spark, d).groupBy(F.col("rule").alias("key"), "day").agg((F.avg("net_bp") / 100.0).alias("r"))
    pools = days.groupBy("key").agg(F.expr("transform(array_sort(collect_list(struct(day, r))), x -> x.r)").alias("returns"))
    sims = montecarlo.bankroll(pools, [0.02, 0.05, 0.1], 200, 1000)
    return sims.groupBy("key", "fraction").agg(F.avg(F.col("ruined").cast("double")).alias("ruin"), F.percentile("end", F.lit(0.5)).alias("median_end"), F.percentile("drawdown", F.lit(0.95)).alias("drawdown95"))


@reg.query()
def power_monte_carlo(spark, d):
    """How often an effect over each rule's own win rate is seen in 200 trades."""
    bases = fills(spark, d).groupBy(F.col("rule").alias("key")).agg(F.avg((F.col("net_bp") > 0).cast("double")).alias("base"))
    return montecarlo.power(bases, [0.03, 0.06, 0.12, 0.24], 200, 2000).groupBy("key", "effect").agg(F.avg(F.col("significant").cast("double")).alias("power"))


@reg.query(f"""WITH {TRADES}, m AS (SELECT *, max(price) OVER (PARTITION BY trader ORDER BY at, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS hw, first_value(price) OVER (PARTITION BY trader ORDER BY at, id) AS e FROM trades)
SELECT trader, min(at) FILTER (price <= e * 0.5) AS stop_at, min(at) FILTER (price >= e * 2) AS tp_at, min(at) FILTER (hw >= e * 2 AND price <= greatest(e, hw * 0.7)) AS trail_at FROM m GROUP BY trader""")
def position_events(spark, d):
    w = Window.partitionBy("trader").orderBy("at", "id")
    t = trades(spark, d).select("trader", "at", "price", F.max("price").over(w.rowsBetween(Window.unboundedPreceding, -1)).alias("hw"), F.first("price").over(w).alias("e"))
    first = lambda c: F.min(F.when(F.expr(c), F.col("at")))
    return t.groupBy("trader").agg(first("price <= e * 0.5").alias("stop_at"), first("price >= e * 2").alias("tp_at"), first("hw >= e * 2 AND price <= greatest(e, hw * 0.7)").alias("trail_at"))


# ---- streams

@reg.query(f"""WITH {TRADES}, b AS (SELECT at // {BAR} * {BAR} AS at, first(price ORDER BY at, id) AS open, max(price) AS high, min(price) AS low, last(price ORDER BY at, id) AS close, sum(usd::DECIMAL(18,2))::DOUBLE AS volume, count(*) AS trades FROM trades GROUP BY 1)
SELECT * FROM b WHERE at + {BAR} <= (SELECT max(at) FROM trades)""")
def stream_candles(spark, d):
    return streams.replay(streams.candles(streams.events(spark, d), "6 hours"))


@reg.query("SELECT DISTINCT event_id, user_id FROM (SELECT * FROM events UNION ALL SELECT * FROM events WHERE event_id % 3 = 0)")
def stream_dedup(spark, d):
    """A third of the events come twice."""
    e = streams.events(spark, d)
    e = e.select("*", F.explode(F.sequence(F.lit(1), F.when(F.col("event_id") % 3 == 0, 2).otherwise(1))).alias("copy")).drop("copy")
    return streams.replay(streams.deduplicated(e, ["event_id"]).select("event_id", "user_id"))


@reg.query(f"""WITH {TRADES}, w AS (SELECT unnest([at // {6 * HOUR} * {6 * HOUR}, at // {6 * HOUR} * {6 * HOUR} - {6 * HOUR}]) AS at, side, usd FROM trades)
SELECT at, coalesce(sum(usd::DECIMAL(18,2)) FILTER (side = 'buy'), 0)::DOUBLE AS buy_usd, coalesce(sum(usd::DECIMAL(18,2)) FILTER (side = 'sell'), 0)::DOUBLE AS sell_usd FROM w WHERE at + {12 * HOUR} <= (SELECT max(at) FROM trades) GROUP BY at""")
def stream_flow(spark, d):
    return streams.replay(streams.flow(streams.events(spark, d), "12 hours", "6 hours"))


@reg.query("""WITH p AS (SELECT user_id, epoch_us(ts) // 1000 AS at, event_id, value + 1 AS price, first_value(value + 1) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS e FROM events),
h AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY at, event_id) AS k FROM p WHERE price <= e * 0.9::DOUBLE OR price >= e * 1.1::DOUBLE) SELECT user_id, at, CASE WHEN price <= e * 0.9::DOUBLE THEN 'stop' ELSE 'target' END AS first_hit FROM h WHERE k = 1""")
def stream_first_hit(spark, d):
    """State over the stream of events: which side of its first price each user's prices reach first."""
    return streams.replay(streams.first_hits(streams.events(spark, d), "user_id", 0.9, 1.1))


@reg.query("""WITH g AS (SELECT user_id, epoch_us(ts) // 1000 AS at, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) < 43200000000 THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT user_id, at, sum(new) OVER (PARTITION BY user_id ORDER BY at ROWS UNBOUNDED PRECEDING) AS run FROM g)
SELECT user_id, min(at) AS start, max(at) + 43200000 AS stop, count(*) AS n FROM s GROUP BY user_id, run HAVING max(at) + 43200000 <= (SELECT max(epoch_us(ts) // 1000) FROM events)""")
def stream_silences(spark, d):
    """Sessions that half a day of silence has ended."""
    return streams.replay(streams.silences(streams.events(spark, d), "user_id", "12 hours"))
