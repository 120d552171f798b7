"""Queries over providers' answers: transfers of wallets, security of tokens."""

from __future__ import annotations

from pyspark.sql import functions as F

from driftline.operators import discovery, security, wallets
from driftline.plans.registry import Registry
from driftline.plans.views import table

reg = Registry()


def receipts(spark, d):
    """Each order as a transaction whose line items are transfers of three tokens, some from its wallet and some to it, as JSON text."""
    li = table(spark, d, "lineitem")
    word = lambda x: F.concat(F.lit("0x"), F.lpad(F.lower(F.hex(x)), 64, "0"))
    me, other = F.concat(F.lit("0x"), F.lpad(F.lower(F.hex("l_orderkey")), 40, "0")), F.lit("0x" + "f" * 40)
    out = F.col("l_returnflag") == "R"
    topics = F.array(F.lit(wallets.TRANSFER), *[F.concat(F.lit("0x" + "0" * 24), F.substring(F.when(out, a).otherwise(b), 3, 40)) for a, b in ((me, other), (other, me))])
    # the amount has 20 more hexadecimal zeros than the price has cents, far beyond 64 bits
    data = F.concat(word(F.round(F.col("l_extendedprice") * 100).cast("long")), F.lit("0" * 20))
    log = F.struct((F.concat(F.lit("0x"), F.lpad((F.col("l_partkey") % 3).cast("string"), 40, "a"))).alias("address"), topics.alias("topics"), F.concat(F.lit("0x"), F.substring(data, 23, 64)).alias("data"))
    rows = li.groupBy("l_orderkey", me.alias("wallet")).agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", log.alias("log")))), lambda x: x["log"]).alias("logs"))  # seven at most
    return rows.select(F.col("l_orderkey").alias("tx"), "wallet", F.to_json(F.struct("logs")).alias("receipt"))


@reg.query("""WITH li AS (SELECT l_orderkey AS tx, l_linenumber AS place, '0x' || lpad((l_partkey % 3)::VARCHAR, 40, 'a') AS token, round(l_extendedprice * 100)::HUGEINT * CASE WHEN l_returnflag = 'R' THEN -1 ELSE 1 END AS amount FROM lineitem WHERE l_extendedprice > 0),
n AS (SELECT tx, token, min(place) AS place, sum(amount)::HUGEINT AS net FROM li GROUP BY ALL),
s AS (SELECT q.tx, CASE WHEN q.net < 0 THEN 'buy' ELSE 'sell' END AS side, t.token, abs(t.net) AS token_amount, abs(q.net) AS quote_amount, row_number() OVER (PARTITION BY q.tx ORDER BY q.place, t.place, t.token) AS k FROM n q JOIN n t ON q.tx = t.tx AND q.token LIKE '%a0' AND t.token NOT LIKE '%a0' AND sign(q.net) = -sign(t.net))
SELECT tx, side, token, (token_amount * 1208925819614629174706176::HUGEINT)::VARCHAR AS token_raw, (quote_amount * 1208925819614629174706176::HUGEINT)::VARCHAR AS quote_raw FROM s WHERE k = 1""")
def wallet_swaps(spark, d):
    """Swaps of wallets from the transfers in their receipts, with the exact amounts."""
    found = wallets.swaps(wallets.evm_deltas(receipts(spark, d)), ["0x" + "a" * 39 + "0"])
    return found.select("tx", "side", "token", "token_raw", "quote_raw")


# ---- security of tokens

def seeded(i):
    """1, absent or 0 of the i-th flag of a customer's token."""
    v = F.col("c_custkey") * (i + 3) % 97
    return F.when(v == 0, "1").when(v > 1, "0")


def answers(spark, d):
    """Each customer as a token with a provider's answer as JSON text: flags, taxes, eleven holders of which one is the pool."""
    # a small file is one task's, but its answers are work for all
    c = table(spark, d, "customer").select("c_custkey").repartition(2 * spark.sparkContext.defaultParallelism)
    token = F.concat(F.lit("0x"), F.lpad(F.hex("c_custkey"), 40, "0"))
    pool = F.lit("0x" + "b" * 40)
    share = lambda j: ((F.col("c_custkey") + j) % 9) / 100.0
    holders = [F.struct(F.lit(f"0x{j:040x}").alias("address"), (F.when(F.col("c_custkey") % 13 == 0, 0.3).otherwise(share(j)) if j == 1 else share(j)).alias("percent")) for j in range(1, 11)]
    data = F.struct(
        F.lit("1").alias("is_open_source"), *[seeded(i).alias(k) for i, k in enumerate(security.EVM_FLAGS)], ((F.col("c_custkey") % 30) / 200.0).alias("buy_tax"), F.when(F.col("c_custkey") % 17 > 0, "0.05").alias("sell_tax"),
        F.array(*holders, F.struct(pool.alias("address"), F.lit(0.5).alias("percent"))).alias("holders"),
    )
    creator = F.struct(F.lit(1).alias("code"), F.struct(*[seeded(100 + i).alias(k) for i, k in enumerate(security.CREATOR_FLAGS)]).alias("result"))
    body = F.to_json(F.struct(F.lit(1).alias("code"), F.create_map(token, data).alias("result"), creator.alias("creatorSecurity")))
    return c.select("c_custkey", F.lit("base").alias("chain"), F.lower(token).alias("token"), body.alias("payload"), pool.alias("pool"))


def told(names, first, prefix=""):
    """SQL of the findings and of the gaps of a family of flags."""
    v = lambda i: f"c_custkey * {first + i + 3} % 97"
    return [f"CASE WHEN {v(i)} = 0 THEN '{prefix}{k}' END" for i, k in enumerate(names)], [f"CASE WHEN {v(i)} = 1 THEN 'Unknown: {prefix}{k}' END" for i, k in enumerate(names)]


RISKY, GAPS = (a + b for a, b in zip(told(security.EVM_FLAGS, 0), told(security.CREATOR_FLAGS, 100, "Creator "), strict=True))
RISKY += ["CASE WHEN (c_custkey % 30) / 200.0::DOUBLE > 0.1 THEN 'buy_tax' END", "CASE WHEN c_custkey % 13 = 0 OR ten > 0.6 THEN 'Dangerous holder concentration' END"]
GAPS += ["CASE WHEN c_custkey % 17 = 0 THEN 'Unknown: sell_tax' END"]


@reg.query(f"""WITH h AS (SELECT c_custkey, CASE WHEN c_custkey % 13 = 0 THEN 0.3::DOUBLE ELSE ((c_custkey + 1) % 9) / 100.0::DOUBLE END + list_sum([((c_custkey + j) % 9) / 100.0::DOUBLE FOR j IN range(2, 11)]) AS ten FROM customer),
r AS (SELECT c_custkey, list_filter([{', '.join(RISKY)}], lambda x: x IS NOT NULL) AS risky, list_filter([{', '.join(GAPS)}], lambda x: x IS NOT NULL) AS gaps FROM h)
SELECT c_custkey, CASE WHEN len(risky) > 0 THEN 'REJECT' WHEN len(gaps) > 0 THEN 'UNKNOWN' ELSE 'PASS' END AS status, array_to_string(list_concat(risky, gaps), ',') AS reasons, round((c_custkey % 30) / 200.0::DOUBLE, 6) AS buy_tax, CASE WHEN c_custkey % 17 > 0 THEN 0.05::DOUBLE END AS sell_tax FROM r""")
def security_check(spark, d):
    """Verdict, reasons and taxes of each token from the provider's answer."""
    found = security.checked(answers(spark, d))
    return found.select("c_custkey", "status", F.array_join("reasons", ",").alias("reasons"), F.round("buy_tax", 6).alias("buy_tax"), "sell_tax")


# ---- discovery

NOW = 1_706_745_600_000


def mint(x):
    return F.lpad(F.translate(x.cast("string"), "0", "Z"), 40, "A")


def notices(spark, d):
    """Each event as a confirmed transaction's message, each tenth failed, with a mint that is malformed."""
    balance = lambda *mints: F.array(*[F.struct(m.alias("mint")) for m in mints])
    meta = F.struct(F.when(F.col("event_id") % 10 == 0, "failed").alias("err"), balance(mint(F.col("user_id"))).alias("preTokenBalances"), balance(mint(F.col("user_id")), mint(F.col("event_id") % 11), F.lit("0")).alias("postTokenBalances"))
    body = F.struct(F.lit("transactionNotification").alias("method"), F.struct(F.struct(F.col("event_id").cast("string").alias("signature"), F.struct(meta.alias("meta")).alias("transaction")).alias("result")).alias("params"))
    return table(spark, d, "events").select(F.unix_millis(F.col("ts").cast("timestamp")).alias("at"), F.to_json(body, {"ignoreNullFields": "false"}).alias("payload"))


@reg.query("""WITH m AS (SELECT event_id, epoch_us(ts) // 1000 AS at, unnest([user_id, event_id % 11]) AS k FROM events WHERE event_id % 10 <> 0)
SELECT DISTINCT 'solana' AS chain, lpad(translate(k::VARCHAR, '0', 'Z'), 40, 'A') AS token, event_id::VARCHAR AS tx, at, 'helius' AS source FROM m""")
def discovery_hints(spark, d):
    """Distinct tokens of each confirmed transaction."""
    return discovery.hints(notices(spark, d))


def feeds(spark, d):
    """Parts as rows of two feeds' answers for two chains, some twenty-five an answer, of several ages; sizes say which fields are absent or zero."""
    p = table(spark, d, "part").select("*", F.when(F.col("p_partkey") % 2 == 0, "base").otherwise("bsc").alias("chain"), F.expr("p_partkey div 2 % 2").alias("feed"), F.expr("p_partkey div 100").alias("page"), (F.col("p_partkey") % 37).alias("k"))
    hexed = lambda x: F.concat(F.lit("0x"), F.lpad(F.lower(F.hex(x)), 40, "0"))
    own = F.concat("chain", F.lit("_"), hexed(F.col("k")))
    row = F.struct(
        F.lit("pool").alias("type"),
        F.struct(
            hexed(F.col("k")).alias("address"), F.lit("2024-01-01T00:00:00Z").alias("pool_created_at"), F.col("p_retailprice").cast("string").alias("reserve_in_usd"), F.struct(F.when(F.col("p_size") % 5 > 0, F.col("p_size") - 1).alias("m5")).alias("volume_usd"),
            F.struct(F.struct(F.col("p_size").alias("buys"), (F.col("p_size") % 3).alias("sells"), F.when(F.col("p_size") % 2 == 0, 0.5).alias("buyers")).alias("m5")).alias("transactions"),
        ).alias("attributes"),
        F.struct(F.struct(F.struct(F.lit("token").alias("type"), own.alias("id")).alias("data")).alias("base_token")).alias("relationships"),
    )
    some = p.groupBy("chain", "feed", "page").agg(F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", row.alias("row")))), lambda x: x["row"]).alias("data"))
    return some.select("chain", F.col("feed").cast("string").alias("feed"), (F.lit(NOW) - F.col("page") % 5 * 60_000 - F.col("page")).alias("fetched_at"), F.to_json(F.struct("data")).alias("payload"))


FEEDS = f"""p AS (SELECT *, CASE WHEN p_partkey % 2 = 0 THEN 'base' ELSE 'bsc' END AS chain, p_partkey // 2 % 2 AS feed, p_partkey // 100 AS page, p_partkey % 37 AS k FROM part),
r AS (SELECT *, row_number() OVER (PARTITION BY chain, feed, page ORDER BY p_partkey) - 1 AS i, {NOW} - page % 5 * 60000 - page AS fetched_at FROM p), w AS (SELECT *, p_size % 5 > 0 AS whole FROM r WHERE i < 20)"""


@reg.query(f"""WITH {FEEDS}, l AS (SELECT *, row_number() OVER (PARTITION BY chain, k ORDER BY fetched_at DESC, feed DESC, i DESC) AS last FROM w WHERE whole)
SELECT chain, CASE chain WHEN 'base' THEN 1 ELSE 0 END AS place, fetched_at, k, p_retailprice::DOUBLE AS liquidity, (p_size - 1)::DOUBLE AS volume5m, p_size::BIGINT AS buys5m, (p_size % 3)::BIGINT AS sells5m, NULL::BIGINT AS buyers5m FROM l WHERE last = 1 AND {NOW} - fetched_at <= 120000""")
def discovery_pools(spark, d):
    """The last row of each pool in fresh answers; a volume of zero is zero, an absent one makes the row incomplete, an odd count is null."""
    rows = discovery.listed(feeds(spark, d), {"base": "base", "bsc": "bsc"})
    found = discovery.pools(rows, ["base", "bsc"], NOW, turn=1)
    return found.select("chain", "place", "fetched_at", F.conv(F.substring("pool", 3, 40), 16, 10).cast("long").alias("k"), "liquidity", "volume5m", "buys5m", "sells5m", "buyers5m")


@reg.query(f"WITH {FEEDS} SELECT chain, count(DISTINCT feed) AS feeds, count(DISTINCT k) FILTER (whole) AS pools, count(*) FILTER (NOT whole) AS ignored, count(DISTINCT feed) = 2 AS ok FROM w GROUP BY chain")
def discovery_health(spark, d):
    return discovery.health(discovery.listed(feeds(spark, d), {"base": "base", "bsc": "bsc"}), 2)
