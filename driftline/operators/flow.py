"""Trade flow: rolling aggregates with an explicit time, and normalised trades."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ratio(a: Column, b: Column) -> Column:
    """a / b; with nothing below, a million if there is something above, else 0."""
    return F.when(b > 0, a / b).when(a > 0, F.lit(1e6)).otherwise(F.lit(0.0))


def flow(trades: DataFrame, keys: list[str]) -> DataFrame:
    """Buys and sells (distinct transactions), USD, distinct traders, and the share of the largest and the top five buyers.

    Two levels: per trader first, then the sums; the five largest come from a rank that Spark
    cuts off before the exchange, so that neither a group's rows nor its traders are gathered.
    """
    usd = F.col("usd").cast("decimal(18,2)")
    buy, sell = F.col("side") == "buy", F.col("side") == "sell"
    counts = trades.groupBy(*keys).agg(F.count_distinct(F.when(buy, F.col("tx"))).alias("buys"), F.count_distinct(F.when(sell, F.col("tx"))).alias("sells"))
    traders = trades.groupBy(*keys, "trader").agg(F.sum(F.when(buy, usd)).alias("b"), F.sum(F.when(sell, usd)).alias("s"))
    largest = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("b").desc_nulls_last()))
    top = traders.select(*keys, "b", largest.alias("__r")).where("__r <= 5").groupBy(*keys).agg(F.coalesce(F.sum("b"), F.lit(0)).cast("double").alias("top5"))
    sums = traders.groupBy(*keys).agg(
        F.coalesce(F.sum("b"), F.lit(0)).cast("double").alias("buy_usd"),
        F.coalesce(F.sum("s"), F.lit(0)).cast("double").alias("sell_usd"),
        F.count("b").alias("buyers"),
        F.count("s").alias("sellers"),
        F.coalesce(F.max("b"), F.lit(0)).cast("double").alias("largest"),
    )
    share = lambda c: F.when(F.col("buy_usd") > 0, F.col(c) / F.col("buy_usd")).otherwise(1.0)
    return counts.join(sums, keys).join(top, keys).select(
        *keys, "buys", "sells", "buy_usd", "sell_usd", "buyers", "sellers",
        ratio(F.col("buys"), F.col("sells")).alias("count_ratio"),
        ratio(F.col("buy_usd"), F.col("sell_usd")).alias("usd_ratio"),
        share("largest").alias("top_buyer_share"),
        share("top5").alias("top5_share"),
    )


def window_of(trades: DataFrame, now: int, length: int) -> DataFrame:
    """Trades in (now - length, now]."""
    return trades.where((F.col("at") > now - length) & (F.col("at") <= now))


def adjacent(trades: DataFrame, keys: list[str], now: int, length: int) -> DataFrame:
    """USD of the last window, the one before it and the one before that."""
    age = F.lit(now) - F.col("at")
    part = lambda k: F.coalesce(F.sum(F.when((age >= k * length) & (age < (k + 1) * length), F.col("usd").cast("decimal(18,2)"))), F.lit(0)).cast("double")
    return trades.where((age >= 0) & (age < 3 * length)).groupBy(*keys).agg(part(0).alias("current"), part(1).alias("previous"), part(2).alias("preceding"))


def price_change(trades: DataFrame, keys: list[str]) -> DataFrame:
    """Percent from the first to the last trade; null for fewer than two."""
    order = F.struct("at", "id")
    ends = trades.groupBy(*keys).agg(F.min_by("price", order).alias("a"), F.max_by("price", order).alias("b"), F.count(F.lit(1)).alias("trades"))
    return ends.select(*keys, "trades", F.when((F.col("trades") >= 2) & (F.col("a") > 0), (F.col("b") / F.col("a") - 1) * 100).alias("change"))


def largest_bar_share(trades: DataFrame, keys: list[str], width: int) -> DataFrame:
    """The largest bar's part of all USD; 1 if there is none."""
    bars = trades.groupBy(*keys, F.expr(f"at div {width}").alias("bar")).agg(F.sum(F.col("usd").cast("decimal(18,2)")).alias("v"))
    whole = bars.groupBy(*keys).agg(F.max("v").cast("double").alias("m"), F.sum("v").cast("double").alias("t"))
    return whole.select(*keys, F.when(F.col("t") > 0, F.col("m") / F.col("t")).otherwise(1.0).alias("share"))


def trade_id(chain: str = "chain", token: str = "pool", tx: str = "tx", trader: str = "trader", side: str = "side", amount: str = "usd") -> Column:
    """sha256 of the JSON array of the trade's identity, its amount in canonical decimal text (no trailing zeros)."""
    text = F.regexp_replace(F.col(amount).cast("decimal(38,10)").cast("string"), r"\.?0+$", "")
    parts = [F.col(c).cast("string") for c in (chain, token, tx, trader, side)] + [text]
    return F.sha2(F.concat(F.lit('["'), F.concat_ws('","', *parts), F.lit('"]')), 256)


def dedup_last(trades: DataFrame, key: str = "id", order: str = "at") -> DataFrame:
    """One row a key, the last by `order`; a partial aggregate, no sort."""
    others = [c for c in trades.columns if c != key]
    last = trades.groupBy(key).agg(F.max_by(F.struct(*others), order).alias("s"))
    return last.select(key, "s.*")


def timely(now: int, ahead: int = 5000) -> Column:
    return (F.col("at") > 0) & (F.col("at") <= now + ahead)


MINUTE = 60_000


def flow_features(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Adds six features of a pool's market flow to snapshots (at, id, buyers, buys, sells, liquidity, volume).

    volume_to_liquidity; buyer_acceleration and count_ratio_trend against the snapshot last seen 5
    minutes before; liquidity_change_15m, _30m and _60m in percent against those of then. Of snapshots of one
    time the last by id is seen. Null where a number is unknown, a divisor is not positive or there is no snapshot; all
    from windows of one exchange and sort. Rows without a time look at nothing and are seen by none.
    """
    values = ["buyers", "buys", "sells", "liquidity"]
    seen = F.when(F.col("at").isNotNull(), F.struct("at", "id", *values))
    order = Window.partitionBy(*keys).orderBy("at")
    ago = lambda minutes: F.max(seen).over(order.rangeBetween(Window.unboundedPreceding, -minutes * MINUTE))
    spans = (5, 15, 30, 60)
    marked = rows.select("*", *[F.when(F.col("at").isNotNull(), ago(m)).alias(f"__{m}") for m in spans])
    over = lambda a, b: F.when(b > 0, a / b)
    number = lambda name: F.when(F.abs(F.col(name)) < float("inf"), F.col(name))
    before = "__5."
    return marked.select(
        *rows.columns,
        F.when(number("liquidity") != 0, number("volume") / number("liquidity")).alias("volume_to_liquidity"),
        (number("buyers") - number(before + "buyers")).alias("buyer_acceleration"),
        (over(number("buys"), number("sells")) - over(number(before + "buys"), number(before + "sells"))).alias("count_ratio_trend"),
        *[(over(number("liquidity"), number(f"__{m}.liquidity")) * 100 - 100).alias(f"liquidity_change_{m}m") for m in spans[1:]],
    )
