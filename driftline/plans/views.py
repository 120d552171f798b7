"""The driver's tables seen as trades, bars and fills, in Spark and as DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.operators import timeseries as ts

HOUR = 3_600_000
BAR = 6 * HOUR


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def millis(column: str) -> Column:
    return F.unix_millis(F.col(column).cast("timestamp"))


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, at (ms), trader, chain, pool, tx, side, usd, price of each event."""
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"),
        millis("ts").alias("at"),
        F.col("user_id").alias("trader"),
        F.concat(F.lit("c"), (F.col("user_id") % 5).cast("string")).alias("chain"),
        F.concat(F.lit("p"), (F.col("user_id") % 3).cast("string")).alias("pool"),
        F.concat(F.col("user_id").cast("string"), F.lit("|"), F.expr(f"unix_millis(cast(ts as timestamp)) div {HOUR}").cast("string")).alias("tx"),
        F.when(F.col("event_type").isin("purchase", "signup", "click"), "buy").otherwise("sell").alias("side"),
        F.col("value").alias("usd"),
        (F.col("value") + 1).alias("price"),
    )


TRADES = f"""trades AS (
  SELECT event_id AS id, epoch_us(ts) // 1000 AS at, user_id AS trader, 'c' || (user_id % 5) AS chain, 'p' || (user_id % 3) AS pool,
         user_id || '|' || (epoch_us(ts) // {1000 * HOUR}) AS tx, CASE WHEN event_type IN ('purchase', 'signup', 'click') THEN 'buy' ELSE 'sell' END AS side,
         value AS usd, value + 1 AS price
  FROM events)"""


def bars(spark: SparkSession, sf_dir: str, width: int = BAR) -> DataFrame:
    return ts.candles(trades(spark, sf_dir), ["chain"], width)


def bars_sql(width: int = BAR) -> str:
    return f"""{TRADES}, bars AS (
  SELECT chain, at // {width} * {width} AS at, first(price ORDER BY at, id) AS open, max(price) AS high, min(price) AS low, last(price ORDER BY at, id) AS close,
         sum(usd::DECIMAL(18, 2))::DOUBLE AS volume, count(*) AS trades FROM trades GROUP BY ALL)"""


BARS = bars_sql()


def fills(spark: SparkSession, sf_dir: str) -> DataFrame:
    """order, line, day, rule, signal, chain, net (percent), gross of each line item."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("o"),
        F.col("l_linenumber").alias("n"),
        F.date_format("l_shipdate", "yyyy-MM-dd").alias("day"),
        F.concat(F.lit("r"), (F.col("l_partkey") % 6).cast("string")).alias("rule"),
        (F.col("l_returnflag") != "N").alias("signal"),
        F.concat(F.lit("c"), (F.col("l_suppkey") % 5).cast("string")).alias("chain"),
        (F.pmod(F.col("l_partkey") * 7919 + F.col("l_orderkey") * 104729 + F.col("l_linenumber") * 31, F.lit(4001)) - 2000).cast("long").alias("net_bp"),
        F.col("l_extendedprice").cast("decimal(18,2)").alias("usd"),
    )


FILLS = """fills AS (
  SELECT l_orderkey AS o, l_linenumber AS n, strftime(l_shipdate, '%Y-%m-%d') AS day, 'r' || (l_partkey % 6) AS rule, l_returnflag <> 'N' AS signal,
         'c' || (l_suppkey % 5) AS chain, ((l_partkey * 7919 + l_orderkey * 104729 + l_linenumber * 31) % 4001 - 2000)::BIGINT AS net_bp,
         l_extendedprice::DECIMAL(18, 2) AS usd FROM lineitem)"""
