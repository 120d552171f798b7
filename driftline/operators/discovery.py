"""Discovery scans: tokens that transactions touch, and pools that public feeds list, from landed JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftline.operators import normalize
from driftline.operators.security import elements, kind, part, text

MINUTE = 60_000
#: Rows of a feed's answer that count, and how old an answer may be.
FIRST, FRESH = 20, 2 * MINUTE

# The form of numbers in text, and of pools' ids on EVM chains.
NUMERIC, POOL = r"(?i)^\d+(\.\d*)?(e[+-]?\d+)?$", "^0x([0-9a-fA-F]{40}|[0-9a-fA-F]{64})$"


def string(value: Column) -> Column:
    return F.when(kind(value) == "STRING", text(value))


def numeric(value: Column) -> Column:
    """A finite number of zero or more, or text of one; an observed zero is zero, what is absent or malformed null."""
    k = kind(value)
    n = F.when((k == "STRING") & text(value).rlike(NUMERIC), text(value).try_cast("double")).when(~k.isin("STRING", "BOOLEAN", "VOID", "OBJECT", "ARRAY"), F.try_variant_get(value, "$", "double"))
    return F.when((n >= 0) & (n < F.lit(float("inf"))), n)


def count(value: Column) -> Column:
    """A whole number that a double holds exactly."""
    n = numeric(value)
    return F.when((n == F.floor(n)) & (n <= 2**53 - 1), n.cast("long"))


def hints(notices: DataFrame) -> DataFrame:
    """chain, token, tx, at, source: each distinct mint among the balances before and after each confirmed transaction, once a transaction.

    notices: at, payload (JSON text). Failed transactions, other messages and answers without both
    lists have no rows; malformed mints are left out.
    """
    read = notices.select("at", F.try_parse_json("payload").alias("v"))
    at = lambda path: part(F.col("v"), f"$.params.result{path}")
    lists = [elements(at(f".transaction.meta.{side}TokenBalances")) for side in ("pre", "post")]
    fine = read.where((string(part(F.col("v"), "$.method")) == "transactionNotification") & (kind(at(".transaction.meta.err")) == "VOID"))
    mints = F.array_distinct(F.array_compact(F.transform(F.concat(*lists), lambda b: normalize.address(F.lit("solana"), string(part(b, "$.mint"))))))
    found = fine.select(string(at(".signature")).alias("tx"), "at", mints.alias("mints")).where("tx IS NOT NULL AND mints IS NOT NULL")
    return found.select(F.lit("solana").alias("chain"), F.explode("mints").alias("token"), "tx", "at", F.lit("helius").alias("source"))


def listed(answers: DataFrame, networks: dict[str, str]) -> DataFrame:
    """Rows of feeds' answers, parsed: chain, feed, fetched_at, place, pool (struct; null where incomplete), valid (the answer as a whole)."""
    names = F.create_map(*[F.lit(x) for kv in networks.items() for x in kv])
    read = answers.select("chain", "feed", "fetched_at", names[F.col("chain")].alias("net"), F.try_parse_json("payload").alias("v"))
    more = part(F.col("v"), "$.included")
    read = read.select("chain", "feed", "fetched_at", "net", elements(part(F.col("v"), "$.data")).alias("data"), F.coalesce(elements(more), F.array().cast("array<variant>")).alias("included"), (more.isNull() | (kind(more) == "ARRAY")).alias("fine"))
    valid = F.coalesce(F.col("fine") & F.col("data").isNotNull(), F.lit(False))
    rows = read.withColumn("valid", valid).select("chain", "feed", "fetched_at", "net", "included", "valid", F.posexplode_outer(F.when(valid, F.slice("data", 1, FIRST))).alias("place", "r"))
    r, chain = F.col("r"), F.col("chain")
    at = lambda path: part(r, f"$.attributes{path}")
    own = string(part(r, "$.relationships.base_token.data.id"))
    token = normalize.address(chain, F.when(own.startswith(F.concat("net", F.lit("_"))), F.substr(own, F.length("net") + 2)))
    rows = rows.select("*", own.alias("own"), token.alias("token"))
    meta = part(F.get(F.filter("included", lambda x: (string(part(x, "$.type")) == "token") & (string(part(x, "$.id")) == F.col("own"))), F.lit(0)), "$.attributes")
    address = string(at(".address"))
    pool = F.when(chain == "solana", normalize.address(chain, address)).otherwise(F.when(address.rlike(POOL), F.lower(address)))
    created = F.unix_millis(F.try_to_timestamp(string(at(".pool_created_at"))))
    price = numeric(at(".base_token_price_usd"))
    titled = lambda path, n, other: F.coalesce(F.nullif(F.substring(string(part(meta, path)), 1, n), F.lit("")), F.lit(other))
    found = F.struct(
        F.col("token"), pool.alias("pool"), created.alias("created_at"), numeric(at(".reserve_in_usd")).alias("liquidity"), numeric(at(".volume_usd.m5")).alias("volume5m"), numeric(at(".volume_usd.h24")).alias("volume24h"),
        *[count(at(f".transactions.m5.{k}")).alias(f"{k}5m") for k in ("buys", "sells", "buyers", "sellers")], titled("$.name", 100, "Unknown token").alias("name"), titled("$.symbol", 30, "?").alias("symbol"), F.when(price > 0, price).alias("price"),
    )
    same = part(meta, "$.address").isNull() | F.coalesce(normalize.address(chain, string(part(meta, "$.address"))) == F.col("token"), F.lit(False))
    rows = rows.select("chain", "feed", "fetched_at", "place", "valid", found.alias("pool"), same.alias("same"), ((string(part(r, "$.type")) == "pool") & (string(part(r, "$.relationships.base_token.data.type")) == "token")).alias("kinds"))
    whole = "kinds AND same AND pool.token IS NOT NULL AND pool.pool IS NOT NULL AND pool.created_at > 0 AND pool.created_at <= fetched_at AND pool.liquidity IS NOT NULL AND pool.volume5m IS NOT NULL AND pool.buys5m IS NOT NULL AND pool.sells5m IS NOT NULL"
    return rows.select("chain", "feed", "fetched_at", "place", "valid", F.when(F.expr(whole), F.col("pool")).alias("pool"))


def pools(rows: DataFrame, chains: list[str], now: int, turn: int = 0) -> DataFrame:
    """The pools of `listed` rows, the last one a pool by (fetched_at, feed, place), of answers no older than FRESH; `turn` rotates the chains' order, told by `place`."""
    last = rows.where("pool IS NOT NULL").groupBy("chain", F.col("pool.pool").alias("id")).agg(F.max_by(F.struct("pool", "fetched_at"), F.struct("fetched_at", "feed", "place")).alias("s"))
    order = F.create_map(*[F.lit(x) for i, c in enumerate(chains) for x in (c, (i - turn) % len(chains))])
    return last.where((F.lit(now) - F.col("s.fetched_at") <= FRESH) & (F.col("s.fetched_at") <= now)).select("chain", order[F.col("chain")].alias("place"), F.col("s.fetched_at").alias("fetched_at"), "s.pool.*")


def health(rows: DataFrame, feeds: int) -> DataFrame:
    """chain, feeds (that answered), pools, ignored (incomplete rows), ok (all feeds answered)."""
    told = rows.groupBy("chain").agg(F.count_distinct(F.when(F.col("valid"), F.col("feed"))).alias("feeds"), F.count_distinct("pool.pool").alias("pools"), F.count_if(F.col("pool").isNull() & F.col("place").isNotNull()).alias("ignored"))
    return told.select("*", (F.col("feeds") == feeds).alias("ok"))
