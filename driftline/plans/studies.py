"""Queries over fills, orders, parts and labels."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from driftline.operators import costs, joins, ledger, resample, screening, simulate, stats
from driftline.operators import timeseries as ts
from driftline.plans.registry import Registry
from driftline.plans.views import BAR, BARS, FILLS, HOUR, TRADES, bars, fills, millis, table, trades

reg = Registry()
R = ["rule"]
DAY = 24 * HOUR


def r6(df, *columns):
    return df.withColumns({c: F.round(c, 6) for c in columns})


# ---- costs

@reg.query("SELECT l_orderkey, l_linenumber, round(greatest(0::DOUBLE, (l_extendedprice * (1 + l_tax) / l_extendedprice - 1) * 10000 + l_discount / l_quantity * 10000), 4) AS bps FROM lineitem")
def cost_observed(spark, d):
    q = F.col("l_extendedprice")
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(costs.observed_bps(q * (1 + F.col("l_tax")), q, F.col("l_discount"), F.col("l_quantity")), 4).alias("bps"))


@reg.query("SELECT s_suppkey, round(CASE WHEN s_acctbal > 0 THEN greatest(100::DOUBLE, 1.5::DOUBLE * (50 / (s_acctbal * 100 / 2) + 50 / (s_acctbal * 90 / 2)) * 10000 + 2 * 30 + 5 / 50::DOUBLE * 10000) END, 4) AS bps FROM supplier")
def cost_model(spark, d):
    a = F.col("s_acctbal")
    return table(spark, d, "supplier").select("s_suppkey", F.round(costs.modelled_bps(F.lit(50.0), a * 100, a * 90, F.lit(30.0), F.lit(5.0)), 4).alias("bps"))


BUCKET = "CASE WHEN l_extendedprice < 50000 THEN '<50k' WHEN l_extendedprice < 100000 THEN '50k-<100k' WHEN l_extendedprice < 250000 THEN '100k-<250k' WHEN l_extendedprice < 1000000 THEN '250k-<1m' ELSE '>=1m' END"


@reg.query(f"SELECT {BUCKET} AS bucket, count(*) AS n FROM lineitem GROUP BY 1")
def cost_buckets(spark, d):
    return table(spark, d, "lineitem").groupBy(costs.liquidity_bucket(F.col("l_extendedprice")).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


@reg.query(f"""WITH f AS (SELECT {BUCKET} AS bucket, 'c' || (l_suppkey % 5) AS chain, l_tax FROM lineitem)
SELECT chain, bucket, count(*) AS n, round(median(l_tax), 6) AS p50, round(quantile_cont(l_tax, 0.75), 6) AS p75, round(quantile_cont(l_tax, 0.9), 6) AS p90 FROM f GROUP BY GROUPING SETS ((), (chain), (bucket))""")
def cost_distribution(spark, d):
    f = table(spark, d, "lineitem").select(costs.liquidity_bucket(F.col("l_extendedprice")).alias("bucket"), F.concat(F.lit("c"), (F.col("l_suppkey") % 5).cast("string")).alias("chain"), "l_tax")
    q = lambda p: F.round(F.percentile("l_tax", F.lit(p)), 6)
    return f.groupingSets([[], ["chain"], ["bucket"]], "chain", "bucket").agg(F.count(F.lit(1)).alias("n"), q(0.5).alias("p50"), q(0.75).alias("p75"), q(0.9).alias("p90"))


@reg.query("SELECT l_returnflag, count(*) AS n, round(avg(CASE WHEN l_tax > l_discount THEN 1.0::DOUBLE ELSE 0 END), 6) AS under, count(*) >= 20 AND avg(CASE WHEN l_tax > l_discount THEN 1.0::DOUBLE ELSE 0 END) > 0.25 AS invalid FROM lineitem GROUP BY 1")
def cost_calibration(spark, d):
    under = F.avg((F.col("l_tax") > F.col("l_discount")).cast("double"))
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.round(under, 6).alias("under"), ((F.count(F.lit(1)) >= 20) & (under > 0.25)).alias("invalid"))


# ---- equity, strategies, tails

EQUITY = f"""{FILLS}, b AS (SELECT *, sum(net_bp) OVER w AS balance FROM fills WINDOW w AS (PARTITION BY rule ORDER BY day, o, n, net_bp ROWS UNBOUNDED PRECEDING)),
e AS (SELECT *, greatest(max(balance) OVER (PARTITION BY rule ORDER BY day, o, n, net_bp ROWS UNBOUNDED PRECEDING), 0) AS peak FROM b)"""


@reg.query(f"WITH {EQUITY} SELECT rule, day, o, n, balance::BIGINT AS balance, (peak - balance)::BIGINT AS drawdown FROM e")
def equity_drawdown(spark, d):
    return stats.equity(fills(spark, d), R, "net_bp", ["day", "o", "n", "net_bp"]).select("rule", "day", "o", "n", "balance", "drawdown")


@reg.query(f"""WITH {EQUITY} SELECT rule, count(*) AS n, round(avg((net_bp > 0)::INT::DOUBLE), 6) AS win_rate, round(avg(net_bp), 6) AS expectancy,
round(sum(net_bp) FILTER (net_bp > 0)::DOUBLE / -sum(net_bp) FILTER (net_bp < 0)::DOUBLE, 6) AS profit_factor, max(peak - balance)::BIGINT AS max_drawdown, sum(net_bp)::BIGINT AS end_balance FROM e GROUP BY rule""")
def strategy_metrics(spark, d):
    return r6(stats.strategy(fills(spark, d), R, "net_bp", ["day", "o", "n", "net_bp"]), "win_rate", "expectancy", "profit_factor")


@reg.query(f"""WITH {FILLS}, t AS (SELECT rule, count(*) AS n, avg(net_bp) AS mean, median(net_bp) AS median, quantile_cont(net_bp, 0.05) AS p5, quantile_cont(net_bp, 0.95) AS p95, quantile_cont(net_bp, 0.99) AS p99, avg((net_bp >= 100)::INT::DOUBLE) AS share_double FROM fills GROUP BY rule)
SELECT t.rule, n, round(mean, 6) AS mean, round(median, 6) AS median, round(p5, 6) AS p5, round(p95, 6) AS p95, round(p99, 6) AS p99, round(share_double, 6) AS share_double,
  round((SELECT avg(net_bp) FROM fills f WHERE f.rule = t.rule AND net_bp < t.p99), 6) AS mean_below_p99 FROM t""")
def tail_summary(spark, d):
    return r6(stats.tail(fills(spark, d), R, "net_bp"), "mean", "median", "p5", "p95", "p99", "share_double", "mean_below_p99")


@reg.query(f"WITH {FILLS} SELECT rule, chain, day, count(*) AS n, round(avg(net_bp), 6) AS mean FROM fills GROUP BY GROUPING SETS ((rule), (rule, chain), (rule, day))")
def base_rate_grouping_sets(spark, d):
    g = fills(spark, d).groupingSets([["rule"], ["rule", "chain"], ["rule", "day"]], "rule", "chain", "day")
    return r6(g.agg(F.count(F.lit(1)).alias("n"), F.avg("net_bp").alias("mean")), "mean")


@reg.query(f"WITH {FILLS} SELECT rule, signal, count(*) AS n, round(avg(net_bp), 6) AS mean, round(avg((net_bp > 0)::INT::DOUBLE), 6) AS win_rate FROM fills GROUP BY rule, signal")
def population_table(spark, d):
    g = fills(spark, d).groupBy("rule", "signal").agg(F.count(F.lit(1)).alias("n"), F.avg("net_bp").alias("mean"), F.avg((F.col("net_bp") > 0).cast("double")).alias("win_rate"))
    return r6(g, "mean", "win_rate")


@reg.query("""WITH a AS (SELECT CASE WHEN p_size < 1 THEN '<1' WHEN p_size < 4 THEN '1-4' WHEN p_size < 24 THEN '4-24' ELSE '>=24' END AS bucket, p_type FROM part)
SELECT bucket, p_type, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY bucket), 6) AS share FROM a GROUP BY bucket, p_type""")
def age_bucket_mix(spark, d):
    s = F.col("p_size")
    b = F.when(s < 1, "<1").when(s < 4, "1-4").when(s < 24, "4-24").otherwise(">=24")
    g = table(spark, d, "part").groupBy(b.alias("bucket"), "p_type").agg(F.count(F.lit(1)).alias("n"))
    return r6(g.select("*", (F.col("n") / F.sum("n").over(Window.partitionBy("bucket"))).alias("share")), "share")


@reg.query("""WITH u AS (UNPIVOT (SELECT o_orderstatus AS population, o_custkey::DOUBLE AS custkey, nullif(o_totalprice, 0) AS price, CASE WHEN o_orderpriority = '5-LOW' THEN NULL ELSE 1.0::DOUBLE END AS priority FROM orders) ON custkey, price, priority INTO NAME field VALUE v),
n AS (SELECT o_orderstatus AS population, count(*) AS n FROM orders GROUP BY 1)
SELECT field, population, count(v) AS present FROM u GROUP BY GROUPING SETS ((field), (field, population))""")
def coverage_audit(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderstatus").alias("population"), F.col("o_custkey").cast("double").alias("custkey"), F.nullif("o_totalprice", F.lit(0.0)).alias("price"), F.when(F.col("o_orderpriority") != "5-LOW", 1.0).alias("priority"))
    u = o.unpivot(["population"], ["custkey", "price", "priority"], "field", "v")
    return u.groupingSets([["field"], ["field", "population"]], "field", "population").agg(F.count("v").alias("present"))


@reg.query("SELECT quality, toxic, count(*) AS n FROM labels GROUP BY GROUPING SETS ((quality), (toxic), (quality, toxic))")
def data_audit(spark, d):
    return table(spark, d, "labels").groupingSets([["quality"], ["toxic"], ["quality", "toxic"]], "quality", "toxic").agg(F.count(F.lit(1)).alias("n"))


@reg.query(f"WITH {FILLS} SELECT rule, chain, list_sort(list(net_bp))[count(*) // 2 + 1] AS upper_median FROM fills GROUP BY rule, chain")
def upper_median(spark, d):
    return stats.upper_median(fills(spark, d), ["rule", "chain"], "net_bp")


# ---- outcome reports

@reg.query(f"""WITH {FILLS}, u AS (UNPIVOT (SELECT net_bp > 0 AS won, usd::DOUBLE AS usd, n::DOUBLE AS line, (o % 97)::DOUBLE AS slot FROM fills) ON usd, line, slot INTO NAME feature VALUE v)
SELECT feature, won, round(median(v), 6) AS median FROM u GROUP BY feature, won""")
def winner_loser_medians(spark, d):
    f = fills(spark, d).select((F.col("net_bp") > 0).alias("won"), F.col("usd").cast("double").alias("usd"), F.col("n").cast("double").alias("line"), (F.col("o") % 97).cast("double").alias("slot"))
    return r6(f.unpivot(["won"], ["usd", "line", "slot"], "feature", "v").groupBy("feature", "won").agg(F.median("v").alias("median")), "median")


@reg.query(f"""WITH {FILLS}, s AS (SELECT unnest(['hold', 'early', 'big']) AS screen, unnest([n >= 3, o % 2 = 0, usd >= 40000]) AS keep, net_bp > 0 AS won FROM fills)
SELECT screen, count(*) FILTER (keep AND won) AS wins_kept, count(*) FILTER (NOT keep AND NOT won) AS losses_avoided, count(*) FILTER (NOT keep AND won) AS wins_missed FROM s GROUP BY screen""")
def screen_scores(spark, d):
    screens = {"hold": F.col("n") >= 3, "early": F.col("o") % 2 == 0, "big": F.col("usd") >= 40000}
    s = fills(spark, d).select((F.col("net_bp") > 0).alias("won"), F.inline(F.array(*[F.struct(F.lit(k).alias("screen"), v.alias("keep")) for k, v in screens.items()])))
    return s.groupBy("screen").agg(F.count_if(F.expr("keep AND won")).alias("wins_kept"), F.count_if(F.expr("NOT keep AND NOT won")).alias("losses_avoided"), F.count_if(F.expr("NOT keep AND won")).alias("wins_missed"))


@reg.query("SELECT o_orderpriority AS version, count(*) AS n, count(*) FILTER (o_orderstatus = 'F') AS first_hit, count(DISTINCT o_orderdate) AS days FROM orders GROUP BY 1")
def plan_outcomes(spark, d):
    return table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("version")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("o_orderstatus") == "F").alias("first_hit"), F.count_distinct("o_orderdate").alias("days"))


REASONS = [("small", "p_retailprice < 950"), ("large", "p_size >= 40"), ("plain", "p_type = 'ECONOMY'"), ("brand", "p_brand = 'Brand#2'")]
REASON_SQL = "list_filter([" + ", ".join(f"CASE WHEN {c} THEN '{n}' END" for n, c in REASONS) + "], lambda x: x IS NOT NULL)"


@reg.query(f"SELECT p_partkey, array_to_string({REASON_SQL}, ',') AS reasons, len({REASON_SQL}) = 0 AS passed, -len({REASON_SQL})::INT AS priority FROM part")
def market_screen(spark, d):
    r = screening.reasons([(n, F.expr(c)) for n, c in REASONS])
    return table(spark, d, "part").select("p_partkey", r.alias("r")).select("p_partkey", F.array_join("r", ",").alias("reasons"), (F.size("r") == 0).alias("passed"), (-F.size("r")).alias("priority"))


@reg.query(f"WITH r AS (SELECT unnest({REASON_SQL}) AS reason FROM part) SELECT reason, count(*) AS n FROM r GROUP BY reason")
def reason_explode(spark, d):
    return table(spark, d, "part").select(F.explode(screening.reasons([(n, F.expr(c)) for n, c in REASONS])).alias("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


@reg.query("SELECT o_orderstatus AS status, o_orderpriority AS decision, count(*) AS n FROM orders GROUP BY ALL")
def decision_histogram(spark, d):
    return table(spark, d, "orders").groupBy(F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("decision")).agg(F.count(F.lit(1)).alias("n"))


@reg.query("SELECT p_partkey FROM part WHERE NOT regexp_replace(upper(p_brand), '[^A-Z0-9]', '', 'g') IN ('BRAND2', 'BRAND17') AND NOT regexp_matches(p_name, '(?i)bolt') AND p_partkey % 31 > 0 AND p_partkey * 13 % 1500 BETWEEN 10 AND 1440")
def shortlist_filter(spark, d):
    """Listed symbols between ten minutes and a day old; every 31st has no known age."""
    created = F.when(F.col("p_partkey") % 31 > 0, F.lit(1_700_000_000_000) - F.col("p_partkey") * 13 % 1500 * 60_000)
    fine = screening.eligible_symbol(F.col("p_brand"), F.col("p_name"), ["BRAND2", "BRAND17"], "(?i)bolt") & screening.eligible_age(created, F.lit(1_700_000_000_000))
    return table(spark, d, "part").where(fine).select("p_partkey")


@reg.query("""WITH c AS (SELECT s_suppkey, least(greatest(s_acctbal / 5000, 0), 1) AS a, least(greatest((20 - s_nationkey) / 15.0::DOUBLE, 0), 1) AS b FROM supplier)
SELECT s_suppkey, floor(10 * a + 0.5)::BIGINT AS liquidity, floor(7 * b + 0.5)::BIGINT AS age, floor(10 * a + 0.5)::BIGINT + floor(7 * b + 0.5)::BIGINT AS score FROM c""")
def score_components(spark, d):
    a, b = screening.clamp(F.col("s_acctbal") / 5000), screening.clamp((20 - F.col("s_nationkey")) / 15.0)
    return table(spark, d, "supplier").select("s_suppkey", F.floor(10 * a + 0.5).alias("liquidity"), F.floor(7 * b + 0.5).alias("age")).select("*", (F.col("liquidity") + F.col("age")).alias("score"))


@reg.query(f"""WITH {TRADES}, q AS (SELECT *, usd > 10 AS qualifies, lag(usd > 10) OVER w AS pq, lag(at) OVER w AS pa, lag(usd) OVER w AS pu, lag(price) OVER w AS pp FROM trades WINDOW w AS (PARTITION BY trader ORDER BY at, id))
SELECT id, coalesce(qualifies AND pq AND at BETWEEN pa + 60000 AND pa + 7200000 AND usd >= pu AND price >= pp, false) AS confirmed FROM q""")
def confirm_two_snapshots(spark, d):
    t = trades(spark, d).select("*", (F.col("usd") > 10).alias("qualifies"))
    return t.select("id", screening.confirmed(t, ["trader"], ["usd", "price"], [], 60_000, 7_200_000).alias("confirmed"))


@reg.query("""WITH s AS (SELECT c_custkey, [x / 100.0::DOUBLE FOR x IN [c_custkey % 7, c_custkey % 11, c_custkey % 13, c_custkey % 31]] AS h, c_acctbal < 0 AS risk, c_mktsegment = 'BUILDING' AS missing FROM customer)
SELECT c_custkey, CASE WHEN risk OR list_max(h) > 0.2 OR list_sum(h) > 0.6 THEN 'REJECT' WHEN missing THEN 'UNKNOWN' ELSE 'PASS' END AS verdict, round(list_max(h), 6) AS top1, round(list_sum(h), 6) AS top10 FROM s""")
def security_verdict(spark, d):
    h = F.array(*[(F.col("c_custkey") % m) / 100.0 for m in (7, 11, 13, 31)])
    s = table(spark, d, "customer").select("c_custkey", "c_acctbal", "c_mktsegment", *[c.alias(n) for c, n in zip(screening.holder_shares(h), ("top1", "top10"), strict=True)])
    risks = screening.reasons([("balance", F.col("c_acctbal") < 0), ("top", F.col("top1") > 0.2), ("ten", F.col("top10") > 0.6)])
    return r6(s.select("c_custkey", screening.verdict(risks, screening.reasons([("segment", F.col("c_mktsegment") == "BUILDING")])).alias("verdict"), "top1", "top10"), "top1", "top10")


@reg.query("""WITH o AS (SELECT p_partkey, p_brand, 'g' || (p_partkey % 5) AS g, p_retailprice AS v FROM part), t AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY v DESC, p_partkey) AS r FROM o),
u AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY v DESC, p_partkey) AS turn FROM t WHERE r = 1) SELECT p_partkey, g, turn FROM u ORDER BY turn, g LIMIT 10""")
def watchlist_round_robin(spark, d):
    p = table(spark, d, "part").select("p_partkey", "p_brand", F.concat(F.lit("g"), (F.col("p_partkey") % 5).cast("string")).alias("g"), F.col("p_retailprice").alias("v"))
    return screening.round_robin(p, "g", [F.col("v").desc(), F.col("p_partkey")], "p_brand", 10).select("p_partkey", "g", F.col("turn").cast("long"))


@reg.query("SELECT s_nationkey, arg_max(s_suppkey, s_acctbal * 1000000 + s_suppkey) AS s_suppkey, max(s_acctbal) AS s_acctbal FROM supplier GROUP BY s_nationkey")
def best_per_group(spark, d):
    return ledger.latest(table(spark, d, "supplier").select("s_nationkey", "s_suppkey", "s_acctbal"), ["s_nationkey"], F.struct("s_acctbal", "s_suppkey"))


@reg.query("WITH l AS (SELECT o_custkey, max(o_orderdate) AS last, arg_max(o_totalprice, epoch_us(o_orderdate) + o_orderkey) AS price, arg_max(o_orderkey, epoch_us(o_orderdate) + o_orderkey) AS k FROM orders GROUP BY 1) SELECT o_custkey, k, price FROM l ORDER BY price DESC NULLS LAST, k LIMIT 5")
def latest_per_key_top5(spark, d):
    o = table(spark, d, "orders").select("o_custkey", F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("price"), "o_orderdate")
    return ledger.latest(o, ["o_custkey"], F.struct("o_orderdate", "k")).select("o_custkey", "k", "price").orderBy(F.col("price").desc_nulls_last(), "k").limit(5)


@reg.query("WITH u AS (SELECT s_suppkey AS k, 1 AS prio, s_acctbal AS v FROM supplier WHERE s_nationkey = 1 UNION ALL SELECT s_suppkey, 2, s_acctbal FROM supplier WHERE s_acctbal > 9000 UNION ALL SELECT s_suppkey, 3, s_acctbal FROM supplier), m AS (SELECT k, min(prio) AS prio, max(v) AS v FROM u GROUP BY k) SELECT k, prio FROM m ORDER BY prio, v DESC, k LIMIT 10")
def priority_union(spark, d):
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), "s_nationkey", F.col("s_acctbal").alias("v"))
    parts = [s.where("s_nationkey = 1").select("k", F.lit(1).alias("prio"), "v"), s.where("v > 9000").select("k", F.lit(2).alias("prio"), "v"), s.select("k", F.lit(3).alias("prio"), "v")]
    union = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return union.groupBy("k").agg(F.min("prio").alias("prio"), F.max("v").alias("v")).orderBy("prio", F.col("v").desc(), "k").limit(10).select("k", "prio")


@reg.query("SELECT o_orderkey FROM orders ORDER BY CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_orderdate END ASC NULLS FIRST, o_totalprice DESC, o_orderkey LIMIT 30")
def refresh_order(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_totalprice", F.when(F.col("o_orderstatus") != "P", F.col("o_orderdate")).alias("e"))
    return o.orderBy(F.col("e").asc_nulls_first(), F.col("o_totalprice").desc(), "o_orderkey").limit(30).select("o_orderkey")


# ---- relational joins

@reg.query("WITH d AS (SELECT l_orderkey AS o_orderkey, bool_and(l_linestatus = 'F') AS done FROM lineitem GROUP BY 1) SELECT o_orderkey FROM orders LEFT JOIN d USING (o_orderkey) WHERE done IS NULL OR NOT done")
def pending_left_join(spark, d):
    done = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.bool_and(F.col("l_linestatus") == "F").alias("done"))
    return joins.pending(table(spark, d, "orders").select("o_orderkey"), done, "o_orderkey", "done").select("o_orderkey")


@reg.query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def unresolved_anti(spark, d):
    return table(spark, d, "customer").join(table(spark, d, "orders"), F.col("o_custkey") == F.col("c_custkey"), "left_anti").select("c_custkey")


@reg.query("SELECT o_orderkey, v AS variant FROM orders, (VALUES ('a', TIMESTAMP '1996-01-01'), ('b', TIMESTAMP '1999-06-01')) r(v, locked) WHERE o_orderdate >= locked")
def cohort_theta_join(spark, d):
    registry = spark.sql("SELECT * FROM VALUES ('a', TIMESTAMP_NTZ '1996-01-01'), ('b', TIMESTAMP_NTZ '1999-06-01') AS r(variant, locked_at)")
    return joins.theta_cohort(table(spark, d, "orders").select("o_orderkey", F.col("o_orderdate").alias("at")), registry).select("o_orderkey", "variant")


@reg.query("SELECT o_orderkey, arg_max(l_linenumber, epoch_us(l_shipdate) + l_linenumber) AS line, max(l_shipdate) AS shipped FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1")
def lateral_latest(spark, d):
    pairs = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_linenumber").alias("line"), F.col("l_shipdate").alias("shipped"))
    last = ledger.latest(pairs, ["o_orderkey"], F.struct("shipped", "line"))
    return last.join(table(spark, d, "orders").select("o_orderkey"), "o_orderkey")


@reg.query("SELECT o_orderkey, c_name, n_name, l_linenumber FROM orders LEFT JOIN customer ON c_custkey = o_custkey LEFT JOIN nation ON n_nationkey = c_nationkey LEFT JOIN lineitem ON l_orderkey = o_orderkey AND l_linestatus = 'F'")
def export_base(spark, d):
    o, c, n, li = (table(spark, d, t) for t in ("orders", "customer", "nation", "lineitem"))
    joined = o.join(c, F.col("c_custkey") == F.col("o_custkey"), "left").join(n, F.col("n_nationkey") == F.col("c_nationkey"), "left")
    return joined.join(li, (F.col("l_orderkey") == F.col("o_orderkey")) & (F.col("l_linestatus") == "F"), "left").select("o_orderkey", "c_name", "n_name", "l_linenumber")


@reg.query("SELECT DISTINCT k FROM (SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier) WHERE k NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)")
def set_operations(spark, d):
    keys = table(spark, d, "customer").select(F.col("c_nationkey").cast("long").alias("k")).union(table(spark, d, "supplier").select(F.col("s_nationkey").cast("long"))).distinct()
    out = table(spark, d, "nation").where("n_regionkey = 1").select(F.col("n_nationkey").cast("long").alias("k"))
    return keys.join(out, "k", "left_anti").select(F.col("k").cast("int").alias("k"))


# ---- ledger and state machines

ORD = "o AS (SELECT o_orderkey AS id, o_custkey AS token, epoch_us(o_orderdate) // 1000 AS at, o_orderstatus AS status, o_totalprice AS v FROM orders)"


def order_rows(spark, d):
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("token"), millis("o_orderdate").alias("at"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("v"))


@reg.query(f"WITH {ORD} SELECT id, count(*) OVER (PARTITION BY token ORDER BY at RANGE BETWEEN {30 * DAY - 1} PRECEDING AND CURRENT ROW) AS used FROM o")
def rolling_cap_ledger(spark, d):
    o = order_rows(spark, d)
    return o.select("id", ledger.rolling_usage(o, ["token"], 30 * DAY).alias("used"))


@reg.query(f"WITH {ORD}, c AS (SELECT *, coalesce(status <> lag(status) OVER w, true)::INT AS c FROM o WINDOW w AS (PARTITION BY token ORDER BY at, id)), r AS (SELECT *, sum(c) OVER (PARTITION BY token ORDER BY at, id ROWS UNBOUNDED PRECEDING) AS run FROM c) SELECT token, any_value(status) AS status, min(at) AS since, max(at) AS until, count(*) AS n FROM r GROUP BY token, run")
def health_transitions(spark, d):
    return ledger.transitions(order_rows(spark, d), ["token"], "status")


@reg.query(f"WITH {ORD}, c AS (SELECT *, coalesce(at - lag(at) OVER (PARTITION BY token ORDER BY at) > {90 * DAY}, true)::INT AS c FROM o), r AS (SELECT *, sum(c) OVER (PARTITION BY token ORDER BY at) AS s FROM c) SELECT token, min(at) AS start, max(at) AS stop, count(*) AS n FROM r GROUP BY token, s")
def stall_sessions(spark, d):
    return ledger.sessions(order_rows(spark, d), ["token"], 90 * DAY)


@reg.query(f"WITH {ORD}, h AS (SELECT *, CASE WHEN v >= 400000 THEN true WHEN v < 350000 THEN false END AS t FROM o) SELECT id, coalesce(last_value(t IGNORE NULLS) OVER (PARTITION BY token ORDER BY at, id ROWS UNBOUNDED PRECEDING), false) AS paused FROM h")
def hysteresis(spark, d):
    return ledger.hysteresis(order_rows(spark, d), ["token"], "v", 400_000, 350_000).select("id", "paused")


@reg.query(f"WITH {ORD} SELECT id, max(v) OVER w AS peak, round(max(v) OVER w * 0.9, 4) AS trail FROM o WINDOW w AS (PARTITION BY token ORDER BY at, id ROWS UNBOUNDED PRECEDING)")
def trailing_stop(spark, d):
    peak, trail = ledger.high_water(["token"], "v", 0.1)
    return order_rows(spark, d).select("id", peak.alias("peak"), F.round(trail, 4).alias("trail"))


@reg.query(f"WITH {ORD} SELECT token, first(id ORDER BY at, id) AS id FROM o GROUP BY token")
def insert_ignore(spark, d):
    o = order_rows(spark, d).select("token", "id", F.struct("at", "id").alias("ord"))
    batches = [ledger.insert_ignore(o.limit(0), o, ["token"], "ord"), o]
    return ledger.insert_ignore(batches[0], batches[1], ["token"], "ord").select("token", "id")


@reg.query(f"WITH {ORD} SELECT token, last(id ORDER BY at, id) AS id FROM o GROUP BY token")
def upsert_last(spark, d):
    o = order_rows(spark, d).select("token", "id", F.struct("at", "id").alias("ord"))
    return ledger.upsert(o.where("id % 2 = 0"), o.where("id % 2 = 1"), ["token"], "ord").select("token", "id")


# ---- classification

SCORED = "s AS (SELECT doc_id, toxic AS y, ((doc_id * 37) % 101 + 1) / 103.0::DOUBLE AS p FROM labels)"


def scored(spark, d):
    return table(spark, d, "labels").select("doc_id", F.col("toxic").alias("y"), (((F.col("doc_id") * 37) % 101 + 1) / 103.0).alias("p"))


@reg.query(f"WITH {SCORED} SELECT count(*) AS n, round(avg((p - y) * (p - y)), 6) AS brier, round(avg(-CASE WHEN y = 1 THEN ln(p) ELSE ln(1 - p) END), 6) AS log_loss FROM s")
def brier_logloss(spark, d):
    return r6(stats.brier_logloss(scored(spark, d), "y", "p"), "brier", "log_loss")


@reg.query(f"WITH {SCORED} SELECT round(sum(CASE WHEN a.p > b.p THEN 1.0::DOUBLE WHEN a.p = b.p THEN 0.5 ELSE 0 END) / count(*), 6) AS auc FROM s a, s b WHERE a.y = 1 AND b.y = 0")
def roc_auc(spark, d):
    return r6(stats.roc_auc(scored(spark, d), "y", "p"), "auc")


@reg.query(f"WITH {SCORED}, g AS (SELECT p, sum(y) AS pos, count(*) AS n FROM s GROUP BY p), c AS (SELECT pos, sum(pos) OVER w AS tp, sum(n) OVER w AS total FROM g WINDOW w AS (ORDER BY p DESC ROWS UNBOUNDED PRECEDING)) SELECT round(sum(pos * tp / total) / sum(pos), 6) AS pr_auc FROM c")
def pr_auc(spark, d):
    return r6(stats.pr_auc(scored(spark, d), "y", "p"), "pr_auc")


EDGES = [0.0, 0.2, 0.4, 0.6, 0.8, 1.0]
BINS = f"{SCORED}, b AS (SELECT (p >= 0.2)::INT + (p >= 0.4)::INT + (p >= 0.6)::INT + (p >= 0.8)::INT AS bin, count(*) AS n, avg(p) AS ms, avg(y) AS mo FROM s GROUP BY 1)"


@reg.query(f"WITH {BINS} SELECT bin::BIGINT AS bin, n, round(ms, 6) AS mean_score, round(mo, 6) AS mean_outcome FROM b")
def reliability_bins(spark, d):
    return r6(stats.reliability(scored(spark, d), "y", "p", EDGES), "mean_score", "mean_outcome")


@reg.query(f"WITH {BINS}, t AS (SELECT sum(n * abs(ms - mo)) / sum(n) AS ece, sum(n * (ms - mo) ** 2) / sum(n) AS r, sum(n * mo ** 2) / sum(n) AS sq, sum(n * mo) / sum(n) AS base FROM b) SELECT round(ece, 6) AS ece, round(r, 6) AS reliability, round(sq - base * base, 6) AS resolution, round(base * (1 - base), 6) AS uncertainty FROM t")
def ece(spark, d):
    return r6(stats.calibration(stats.reliability(scored(spark, d), "y", "p", EDGES)), "ece", "reliability", "resolution", "uncertainty")


QUANTILES = f"""{SCORED}, t AS (SELECT list(p ORDER BY p) AS v, count(*) AS n, least(10, greatest(2, count(*) // 25), count(DISTINCT p)) AS b FROM s),
e AS (SELECT list_distinct(list_transform(range(b + 1), lambda k: v[floor((n - 1) * k / b)::INT + 1] + (v[least(floor((n - 1) * k / b)::INT + 2, n)] - v[floor((n - 1) * k / b)::INT + 1]) * ((n - 1) * k / b - floor((n - 1) * k / b)))) AS edges FROM t),
b AS (SELECT len(list_filter(edges, lambda x: x > list_min(edges) AND x < p)) AS bin, count(*) AS n, avg(p) AS ms, avg(y) AS mo FROM s, e GROUP BY 1)"""


@reg.query(f"WITH {QUANTILES} SELECT bin, n, round(ms, 6) AS mean_score, round(mo, 6) AS mean_outcome FROM b")
def quantile_reliability(spark, d):
    return r6(stats.quantile_reliability(scored(spark, d), "y", "p"), "mean_score", "mean_outcome")


@reg.query(f"WITH {QUANTILES}, t2 AS (SELECT sum(n * abs(ms - mo)) / sum(n) AS ece, sum(n * (ms - mo) ** 2) / sum(n) AS r, sum(n * mo ** 2) / sum(n) AS sq, sum(n * mo) / sum(n) AS base FROM b) SELECT round(ece, 6) AS ece, round(r, 6) AS reliability, round(sq - base * base, 6) AS resolution, round(base * (1 - base), 6) AS uncertainty FROM t2")
def quantile_calibration(spark, d):
    return r6(stats.calibration(stats.quantile_reliability(scored(spark, d), "y", "p")), "ece", "reliability", "resolution", "uncertainty")


@reg.query(f"WITH {FILLS}, k AS (SELECT rule, rank() OVER (PARTITION BY rule ORDER BY net_bp) + (count(*) OVER (PARTITION BY rule, net_bp) - 1) / 2.0::DOUBLE AS a, rank() OVER (PARTITION BY rule ORDER BY usd) + (count(*) OVER (PARTITION BY rule, usd) - 1) / 2.0::DOUBLE AS b FROM fills) SELECT rule, round(corr(a, b), 6) AS rho FROM k GROUP BY rule")
def spearman_rank(spark, d):
    return r6(stats.spearman(fills(spark, d), R, "net_bp", "usd"), "rho")


# ---- resampling

BLOCKS = f"""{FILLS}, days AS (SELECT rule, day AS m, sum(net_bp) AS s, count(*) AS n FROM fills GROUP BY ALL),
b AS (SELECT *, row_number() OVER (PARTITION BY rule ORDER BY m) - 1 AS i, count(*) OVER (PARTITION BY rule) AS k FROM days)"""


@reg.query(f"""WITH {BLOCKS}, p AS (SELECT rule, rep, ({resample.draw_sql(7, 'rep', 'i')}) % k AS i FROM b, range(1000) g(rep)), m AS (SELECT p.rule, rep, sum(s)::DOUBLE / sum(n) AS m FROM p JOIN b ON b.rule = p.rule AND b.i = p.i GROUP BY ALL),
e AS (SELECT rule, quantile_cont(m, 0.025) AS low, quantile_cont(m, 0.975) AS high FROM m GROUP BY rule)
SELECT rule, round(sum(s)::DOUBLE / sum(n), 6) AS mean, count(*) AS days, round(any_value(low), 6) AS low, round(any_value(high), 6) AS high FROM b JOIN e USING (rule) GROUP BY rule""")
def day_block_bootstrap(spark, d):
    return r6(resample.bootstrap(fills(spark, d), R, "day", F.col("net_bp"), 1000, 7), "mean", "low", "high")


PAIRS = f"{FILLS}, pd AS (SELECT rule, day AS m, avg(net_bp) FILTER (signal) - avg(net_bp) FILTER (NOT signal) AS diff FROM fills GROUP BY ALL HAVING count(*) FILTER (signal) > 0 AND count(*) FILTER (NOT signal) > 0)"


def paired_days(spark, d):
    g = fills(spark, d).groupBy("rule", F.col("day").alias("m")).agg(F.avg(F.when(F.col("signal"), F.col("net_bp"))).alias("a"), F.avg(F.when(~F.col("signal"), F.col("net_bp"))).alias("b"))
    return g.where("a IS NOT NULL AND b IS NOT NULL").select("rule", "m", (F.col("a") - F.col("b")).alias("diff"))


@reg.query(f"WITH {PAIRS} SELECT rule, count(*) AS pair_days, round(avg(diff), 6) AS diff FROM pd GROUP BY rule")
def matched_pair_days(spark, d):
    return r6(paired_days(spark, d).groupBy("rule").agg(F.count(F.lit(1)).alias("pair_days"), F.avg("diff").alias("diff")), "diff")


@reg.query(f"""WITH {PAIRS}, q AS (SELECT rule, round(diff * 1000)::BIGINT AS v, dense_rank() OVER (ORDER BY m) - 1 AS i FROM pd),
x AS (SELECT rule, rep, sum(CASE WHEN ((({resample.draw_sql(11, 'rep', 'i')})) >> 8) % 2 = 0 THEN v ELSE -v END) / count(*)::DOUBLE AS m FROM q, range(1000) g(rep) GROUP BY ALL), o AS (SELECT rule, sum(v) / count(*)::DOUBLE AS mean FROM q GROUP BY rule)
SELECT rule, round((count(*) FILTER (x.m <= o.mean) + 1) / 1001.0::DOUBLE, 6) AS p FROM x JOIN o USING (rule) GROUP BY rule""")
def sign_flip_permutation(spark, d):
    q = paired_days(spark, d).select("rule", F.round(F.col("diff") * 1000).cast("long").alias("v"), (F.dense_rank().over(Window.orderBy("m")) - 1).alias("i"))
    return r6(resample.sign_flip(q, R, "i", "v", 1000, 11), "p")


@reg.query(f"""WITH {FILLS}, c AS (SELECT rule, o, n, day, net_bp, o * 10 + n AS x, count(*) FILTER (signal) OVER (PARTITION BY rule, day) AS k FROM fills),
r AS (SELECT rule, rep, net_bp, k, row_number() OVER (PARTITION BY rule, rep, day ORDER BY {resample.draw_sql(5, 'rep', 'x')}, o, n, net_bp) AS r FROM c, range(500) g(rep) WHERE k > 0) SELECT rule, rep::INT AS rep, round(sum(net_bp)::DOUBLE / count(*), 6) AS mean FROM r WHERE r <= k GROUP BY rule, rep""")
def within_day_permutation(spark, d):
    """Every rule, 500 replicates."""
    return r6(resample.within_day_permutation(fills(spark, d), "day", "signal", ["o", "n", "net_bp"], F.col("net_bp"), 500, 5, F.col("o") * 10 + F.col("n"), R), "mean")


@reg.query()
def within_day_permutation_all_rules(spark, d):
    """As within_day_permutation, with 200 replicates."""
    return r6(resample.within_day_permutation(fills(spark, d), "day", "signal", ["o", "n", "net_bp"], F.col("net_bp"), 200, 5, F.col("o") * 10 + F.col("n"), R), "mean")


@reg.query()
def whole_day_block_bootstrap(spark, d):
    """As day_block_bootstrap, with 200 replicates."""
    return r6(resample.bootstrap(fills(spark, d), R, "day", F.col("net_bp"), 200, 7), "mean", "low", "high")


@reg.query(f"WITH {PAIRS} SELECT rule, count(*) AS pair_days, round(avg(diff), 6) AS diff FROM pd GROUP BY rule")
def whole_day_matched_pairs(spark, d):
    return matched_pair_days(spark, d)


@reg.query()
def whole_day_sign_flip(spark, d):
    """As sign_flip_permutation, with 200 replicates."""
    q = paired_days(spark, d).select("rule", F.round(F.col("diff") * 1000).cast("long").alias("v"), (F.dense_rank().over(Window.orderBy("m")) - 1).alias("i"))
    return r6(resample.sign_flip(q, R, "i", "v", 200, 11), "p")


@reg.query(f"""WITH {PAIRS}, q AS (SELECT rule, round(diff * 1000)::BIGINT AS v, dense_rank() OVER (ORDER BY m) - 1 AS i FROM pd),
x AS (SELECT rule, rep, sum(CASE WHEN ((({resample.draw_sql(11, 'rep', 'i')})) >> 8) % 2 = 0 THEN v ELSE -v END) / count(*)::DOUBLE AS m FROM q, range(1000) g(rep) GROUP BY ALL), l AS (SELECT rep, min(m) AS m FROM x GROUP BY rep), o AS (SELECT rule, sum(v) / count(*)::DOUBLE AS mean FROM q GROUP BY rule ORDER BY 2, 1 LIMIT 1)
SELECT rule AS best, round(mean, 6) AS mean, round(((SELECT count(*) FROM l WHERE l.m <= o.mean) + 1) / 1001.0::DOUBLE, 6) AS p FROM o""")
def family_wise_sign_flip(spark, d):
    """Whether the rule with the lowest mean difference is lower than the lowest of all rules under random signs of days."""
    q = paired_days(spark, d).select("rule", F.round(F.col("diff") * 1000).cast("long").alias("v"), (F.dense_rank().over(Window.orderBy("m")) - 1).alias("i"))
    return r6(resample.sign_flip_family(q, "rule", "i", "v", 1000, 11), "mean", "p")


# ---- selection and sensitivity

@reg.query(f"WITH {FILLS} SELECT chain, round(avg(-net_bp) FILTER (net_bp <= 0) / (avg(net_bp) FILTER (net_bp > 0) + avg(-net_bp) FILTER (net_bp <= 0)), 6) AS breakeven FROM fills GROUP BY chain")
def breakeven(spark, d):
    return r6(fills(spark, d).groupBy("chain").agg(stats.breakeven("net_bp").alias("breakeven")), "breakeven")


@reg.query(f"WITH {FILLS}, m AS (SELECT chain, rule, avg(net_bp) AS mean, count(*) AS n FROM fills GROUP BY ALL HAVING count(*) >= 30), k AS (SELECT *, row_number() OVER (PARTITION BY chain ORDER BY mean DESC, rule) AS r FROM m) SELECT chain, rule, round(mean, 6) AS mean, n FROM k WHERE r = 1")
def best_rule_selection(spark, d):
    return r6(stats.best_rule(fills(spark, d), ["chain"], "rule", "net_bp", 30), "mean")


@reg.query(f"WITH {FILLS}, m AS (SELECT chain, rule, avg(net_bp) AS mean FROM fills GROUP BY ALL), g AS (SELECT chain, max(mean) - min(mean) AS swing FROM m GROUP BY chain) SELECT round(avg(swing), 6) AS swing FROM g")
def lever_swing(spark, d):
    m = fills(spark, d).groupBy("chain", "rule").agg(F.avg("net_bp").alias("mean"))
    return r6(m.groupBy("chain").agg((F.max("mean") - F.min("mean")).alias("swing")).agg(F.avg("swing").alias("swing")), "swing")


@reg.query(f"""WITH {FILLS}, m AS (SELECT rule, avg(net_bp) FILTER (net_bp > 0) AS win, avg(-net_bp) FILTER (net_bp <= 0) AS loss, avg((net_bp > 0)::INT::DOUBLE) AS rate FROM fills GROUP BY rule)
SELECT rule, a / 2.0::DOUBLE AS wins, b / 2.0::DOUBLE AS losses, round(b / 2.0::DOUBLE * loss / (a / 2.0::DOUBLE * win + b / 2.0::DOUBLE * loss), 6) AS breakeven, round(rate - b / 2.0::DOUBLE * loss / (a / 2.0::DOUBLE * win + b / 2.0::DOUBLE * loss), 6) AS margin FROM m, range(1, 7) x(a), range(1, 7) y(b)""")
def payoff_grid(spark, d):
    """Each rule's breakeven win rate were its wins and losses half to three times as large, and what its own rate has over it."""
    m = fills(spark, d).groupBy("rule").agg(F.avg(F.when(F.col("net_bp") > 0, F.col("net_bp"))).alias("win"), F.avg(F.when(F.col("net_bp") <= 0, -F.col("net_bp"))).alias("loss"), F.avg((F.col("net_bp") > 0).cast("double")).alias("rate"))
    axis = F.sequence(F.lit(1), F.lit(6))
    g = m.select("*", F.explode(axis).alias("a")).select("*", F.explode(axis).alias("b")).select("rule", "rate", "win", "loss", (F.col("a") / 2.0).alias("wins"), (F.col("b") / 2.0).alias("losses"))
    g = g.select("*", (F.col("losses") * F.col("loss") / (F.col("wins") * F.col("win") + F.col("losses") * F.col("loss"))).alias("breakeven"))
    return r6(g.select("rule", "wins", "losses", "breakeven", (F.col("rate") - F.col("breakeven")).alias("margin")), "breakeven", "margin")


@reg.query(f"""WITH {FILLS}, m AS (SELECT rule, chain, avg((net_bp > 0)::INT::DOUBLE) AS rate FROM fills GROUP BY ALL), b AS (SELECT avg((net_bp > 0)::INT::DOUBLE) AS base FROM fills), e AS (SELECT rule, chain, base, round(abs(rate - base), 4) AS effect FROM m, b)
SELECT rule, chain, effect, CASE WHEN effect > 0 THEN ceil(round(((1.959964::DOUBLE + 0.841621::DOUBLE) / effect) ** 2 * base * (1 - base), 3))::BIGINT END AS n FROM e""")
def required_n(spark, d):
    """Trades it would take to see each group's distance from the common win rate, at 5 % and a power of 80 %."""
    won = F.avg((F.col("net_bp") > 0).cast("double"))
    f = fills(spark, d)
    e = f.groupBy("rule", "chain").agg(won.alias("rate")).crossJoin(F.broadcast(f.agg(won.alias("base")))).select("rule", "chain", "base", F.round(F.abs(F.col("rate") - F.col("base")), 4).alias("effect"))
    need = F.pow((F.lit(1.959964) + F.lit(0.841621)) / F.col("effect"), F.lit(2.0)) * F.col("base") * (1 - F.col("base"))
    return e.select("rule", "chain", "effect", F.when(F.col("effect") > 0, F.ceil(F.round(need, 3))).cast("long").alias("n"))


@reg.query(f"WITH {FILLS}, t AS (SELECT c / 100.0::DOUBLE AS threshold, avg(net_bp) AS mean, count(*) AS n FROM fills, range(35, 81, 5) g(c) WHERE (o * 37 % 101) >= c GROUP BY c HAVING count(*) >= 5) SELECT threshold, round(mean, 6) AS mean, n FROM t ORDER BY t.mean DESC, threshold LIMIT 1")
def threshold_choice(spark, d):
    f = fills(spark, d).select("net_bp", F.explode(F.sequence(F.lit(35), F.lit(80), F.lit(5))).alias("c"), (F.col("o") * 37 % 101).alias("score")).where("score >= c")
    t = f.groupBy((F.col("c") / 100.0).alias("threshold")).agg(F.avg("net_bp").alias("mean"), F.count(F.lit(1)).alias("n")).where("n >= 5")
    return r6(t.orderBy(F.col("mean").desc(), "threshold").limit(1), "mean")


PLAN = ["stop", "entry_min", "entry_max", "target", "risk_pct"]


@reg.query(f"WITH {BARS} SELECT chain, at, round(low * 0.995, 6) AS stop, round(greatest(low, close * 0.99), 6) AS entry_min, round(least(close * 1.02, low * 0.995 / 0.9), 6) AS entry_max, round(close * 2, 6) AS target, round((1 - low * 0.995 / close) * 100, 6) AS risk_pct FROM bars")
def trade_plan(spark, d):
    p = screening.trade_plan(F.col("low"), F.col("close"))
    return bars(spark, d).select("chain", "at", *[F.round(p[c], 6).alias(c) for c in PLAN])


# ---- simulation

def path_rows(spark, d, length=8):
    """Each bar as an observation whose path is the next `length` bars; the entry is the first open."""
    b = bars(spark, d)
    start = b.select("chain", F.col("at").alias("at"))
    pairs = joins.range_join(start, b, ["chain"], length * BAR)
    w = Window.partitionBy("id").orderBy("bar")
    rows = pairs.select(F.concat_ws("|", "chain", F.col("at").cast("string")).alias("id"), F.col("r.at").alias("bar"), "r.open", "r.high", "r.low", "r.close")
    return rows.select("*", (F.row_number().over(w) - 1).alias("i"), F.first("open").over(w).alias("entry"))


PATHS = f"""{BARS}, pr AS (SELECT a.chain || '|' || a.at AS id, b.at AS bar, b.open, b.high, b.low, b.close FROM bars a JOIN bars b ON a.chain = b.chain AND b.at >= a.at AND b.at < a.at + {8 * BAR}),
paths AS (SELECT *, row_number() OVER w - 1 AS i, first_value(open) OVER w AS entry FROM pr WINDOW w AS (PARTITION BY id ORDER BY bar))"""


@reg.query(f"""WITH {PATHS}, e AS (SELECT id, min(i) FILTER (low <= entry * 0.5) AS si, arg_min(least(entry * 0.5, open), i) FILTER (low <= entry * 0.5) AS fill, min(i) FILTER (high >= entry * 1.5) AS ti, arg_max(close, i) AS last, max(i) AS li, any_value(entry) AS entry FROM paths GROUP BY id)
SELECT id, round(CASE WHEN si IS NOT NULL AND (ti IS NULL OR si <= ti) THEN (fill / entry - 1) * 100 WHEN ti IS NOT NULL THEN 50 ELSE (last / entry - 1) * 100 END, 6) AS gross,
CASE WHEN si IS NOT NULL AND (ti IS NULL OR si <= ti) THEN 'stop' WHEN ti IS NOT NULL THEN 'target' ELSE 'time' END AS reason, CASE WHEN si IS NOT NULL AND (ti IS NULL OR si <= ti) THEN si WHEN ti IS NOT NULL THEN ti ELSE li END + 1 AS bars FROM e""")
def path_sim_single_target(spark, d):
    return r6(simulate.single_target(path_rows(spark, d), 50, 50), "gross")


def grid_paths(spark, d, length=28):
    """Paths of 168 hours with the atr of the bar before the entry and, as support, 0.5 % below the lowest of 20 bars before it."""
    keys = ["chain"]
    b = ts.atr(bars(spark, d), keys)
    before = ts.ordered(keys)
    start = b.select("chain", "at", F.lag("atr").over(before).alias("atr"), (F.min("low").over(before.rowsBetween(-20, -1)) * 0.995).alias("support"))
    pairs = joins.range_join(start, bars(spark, d), keys, length * BAR)
    w = Window.partitionBy("id").orderBy("at")
    rows = pairs.select(F.concat_ws("|", "chain", F.col("at").cast("string")).alias("id"), "atr", "support", F.col("r.at").alias("at"), "r.open", "r.high", "r.low", "r.close")
    return rows.select("*", (F.row_number().over(w) - 1).cast("long").alias("i"), F.first("open").over(w).alias("entry"))


GRID_CELLS = " UNION ALL ".join(
    f"SELECT * FROM (SELECT unnest([{', '.join(repr(x) for x in g.structures)}]) AS structure), (SELECT unnest([{', '.join(repr(x) for x in g.stops)}]) AS stop), (SELECT unnest({list(g.hours)}) AS hours), (SELECT unnest({list(g.targets)}::DOUBLE[]) AS target), (SELECT unnest({list(g.trails)}::DOUBLE[]) AS trail)"
    for g in (simulate.EXITS, *simulate.EDGES)
)
#: Bar by bar: each cell's level on each bar of each path, and the first bar where something ends the trade.
GRID = f"""{BARS}, tr AS (SELECT *, greatest(high - low, abs(high - lag(close) OVER o), abs(low - lag(close) OVER o)) AS t, row_number() OVER o AS k FROM bars WINDOW o AS (PARTITION BY chain ORDER BY at)),
ab AS (SELECT *, CASE WHEN k >= 15 THEN avg(t) OVER (PARTITION BY chain ORDER BY at ROWS 13 PRECEDING) END AS atr0 FROM tr),
st AS (SELECT chain, at, lag(atr0) OVER o AS atr, min(low) OVER (PARTITION BY chain ORDER BY at ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) * 0.995::DOUBLE AS support FROM ab WINDOW o AS (PARTITION BY chain ORDER BY at)),
pp AS (SELECT a.chain || '|' || a.at AS id, a.at AS since, a.atr, a.support, b.at AS bar_at, b.open, b.high, b.low, b.close, row_number() OVER w - 1 AS i, first_value(b.open) OVER w AS entry FROM st a JOIN bars b ON a.chain = b.chain AND b.at >= a.at AND b.at < a.at + {28 * BAR} WINDOW w AS (PARTITION BY a.chain, a.at ORDER BY b.at)),
cells AS ({GRID_CELLS}),
c0 AS (SELECT *, CASE WHEN stop = 'support' THEN support WHEN stop LIKE 'fixed%' THEN entry * (1 - stop[6:]::DOUBLE / 100) WHEN atr > 0 THEN entry - stop[4:]::DOUBLE * atr END AS s FROM pp, cells WHERE bar_at < since + hours * {HOUR}),
c1 AS (SELECT * FROM c0 WHERE s > 0 AND s < entry AND (structure <> 'trailing' OR atr > 0)),
c2 AS (SELECT *, min(CASE WHEN high >= entry * CASE WHEN structure = 'ladder' THEN 2.0::DOUBLE ELSE 1 + target / 100 END THEN i END) OVER g AS a, min(CASE WHEN high >= entry * 5 THEN i END) OVER g AS five,
  greatest(entry, max(high) OVER (PARTITION BY id, structure, stop, hours, target, trail ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) AS top FROM c1 WINDOW g AS (PARTITION BY id, structure, stop, hours, target, trail)),
c3 AS (SELECT *, max(CASE WHEN i >= a THEN high END) OVER (PARTITION BY id, structure, stop, hours, target, trail ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS since_hit FROM c2),
c4 AS (SELECT *, CASE WHEN structure = 'fat' AND i > 0 THEN greatest(s, top * (1 - trail / 100)) WHEN structure = 'ladder' AND i > a THEN greatest(s, top * (1 - trail / 100)) WHEN structure = 'trailing' AND i > a THEN greatest(s, since_hit - atr) ELSE s END AS level FROM c3),
c5 AS (SELECT *, CASE WHEN structure = 'fat' THEN CASE WHEN low <= level THEN 'trail' END
  WHEN structure = 'ladder' THEN CASE WHEN low <= level THEN CASE WHEN i > a THEN 'trail' ELSE 'stop' END END
  WHEN a IS NULL OR i <= a THEN CASE WHEN low <= s THEN 'stop' WHEN i = a AND structure = 'single' THEN 'tp' WHEN i = a AND structure = 'half' AND low <= entry THEN 'breakeven'
    WHEN i = a AND structure = 'half' AND high >= entry * (1 + target / 50) THEN 'tp2' WHEN i = a AND structure = 'trailing' AND low <= greatest(s, high - atr) THEN 'trail' END
  WHEN structure = 'half' THEN CASE WHEN low <= entry THEN 'breakeven' WHEN high >= entry * (1 + target / 50) THEN 'tp2' END
  WHEN structure = 'trailing' THEN CASE WHEN low <= level THEN 'trail' END END AS event FROM c4),
c6 AS (SELECT *, CASE event WHEN 'tp' THEN entry * (1 + target / 100) WHEN 'tp2' THEN entry * (1 + target / 50) WHEN 'breakeven' THEN entry WHEN 'trail' THEN CASE WHEN structure = 'trailing' AND i = a THEN greatest(s, high - atr) ELSE least(level, open) END WHEN 'stop' THEN least(s, open) END AS fill FROM c5),
c7 AS (SELECT id, structure, stop, hours, target, trail, min(i) FILTER (event IS NOT NULL) AS x, max(i) AS n, any_value(entry) AS entry, any_value(since) AS since, any_value(a) AS a, any_value(five) AS five FROM c6 GROUP BY ALL),
c8 AS (SELECT c7.*, c6.event, coalesce(c6.fill, c6.close) AS price, c6.bar_at, CASE WHEN c6.event IS NOT NULL AND structure IN ('fat', 'ladder') THEN c6.top ELSE greatest(c6.top, c6.high) END AS best,
  c6.bar_at + {BAR} >= c7.since + hours * {HOUR} AS complete FROM c7 JOIN c6 USING (id, structure, stop, hours, target, trail) WHERE c6.i = coalesce(x, n)),
c9 AS (SELECT *, (price / entry - 1) * 100 AS pct, a IS NOT NULL AND (event IS NULL OR event <> 'stop') AS turned FROM c8),
sim AS (SELECT id, structure, stop, hours, target, trail, CASE WHEN structure IN ('half', 'trailing') AND turned THEN (target + pct) / 2 WHEN structure = 'ladder' AND turned AND five < coalesce(x, n + 1) THEN 125 + 0.5::DOUBLE * pct WHEN structure = 'ladder' AND turned THEN 25 + 0.75::DOUBLE * pct ELSE pct END AS gross,
  coalesce(event, CASE WHEN complete THEN 'time' ELSE 'open' END) AS reason, coalesce(x, n) + 1 AS bars, best / entry AS best, event IS NOT NULL OR complete AS resolved, bar_at + {BAR} AS exit_at FROM c9),
priced AS (SELECT *, cost_bps, gross - cost_bps / 100.0::DOUBLE AS net FROM sim, (SELECT unnest([100, 200, 300]) AS cost_bps))"""


@reg.query(f"WITH {GRID} SELECT id, structure, stop, hours, target, trail, reason, bars, resolved, exit_at, cost_bps, round(gross, 6) + 0.0::DOUBLE AS gross, round(best, 6) AS best, round(net, 6) + 0.0::DOUBLE AS net FROM priced")
def path_sim_grid(spark, d):
    """All 432 cells of the exit grid and 144 of the edge grid."""
    paths = grid_paths(spark, d)
    cells = [simulate.simulate(paths, g, BAR) for g in (simulate.EXITS, *simulate.EDGES)]
    found = r6(simulate.with_costs(cells[0].unionByName(cells[1]).unionByName(cells[2]), list(simulate.COSTS)), "gross", "best", "net")
    return found.withColumns({c: F.col(c) + F.lit(0.0) for c in ("gross", "net")})  # no negative zero


CELL = ["structure", "stop", "hours", "target", "trail", "cost_bps"]


@reg.query(f"WITH {GRID} SELECT {', '.join(CELL)}, count(*) AS n, count(*) FILTER (resolved) AS resolved, round(avg(net), 4) AS mean, round(avg((round(net, 6) > 0)::INT::DOUBLE), 6) AS win_rate, round(avg(bars), 6) AS bars, round(max(best), 6) AS best FROM priced GROUP BY ALL")
def grid_summary(spark, d):
    g = path_sim_grid(spark, d).groupBy(*CELL)
    found = g.agg(F.count(F.lit(1)).alias("n"), F.count_if("resolved").alias("resolved"), F.round(F.avg("net"), 4).alias("mean"), F.avg((F.col("net") > 0).cast("double")).alias("win_rate"), F.avg("bars").alias("bars"), F.max("best").alias("best"))
    return r6(found, "win_rate", "bars", "best")


@reg.query(f"WITH {PATHS} SELECT id, count(*) AS observed, max(high) AS mfe_price, min(low) AS mae_price, round((max(high) / any_value(entry) - 1) * 100, 6) AS mfe, round((min(low) / any_value(entry) - 1) * 100, 6) AS mae, min(i) FILTER (high = m) AS mfe_bar FROM (SELECT *, max(high) OVER (PARTITION BY id) AS m FROM paths) GROUP BY id")
def excursions(spark, d):
    p = path_rows(spark, d)
    g = p.groupBy("id").agg(F.count(F.lit(1)).alias("observed"), F.max("high").alias("mfe_price"), F.min("low").alias("mae_price"), F.first("entry").alias("entry"), F.max_by("i", F.struct("high", -F.col("i"))).cast("long").alias("mfe_bar"))
    return r6(g.select("id", "observed", "mfe_price", "mae_price", ((F.col("mfe_price") / F.col("entry") - 1) * 100).alias("mfe"), ((F.col("mae_price") / F.col("entry") - 1) * 100).alias("mae"), "mfe_bar"), "mfe", "mae")
