"""Streaming twins of the batch operators, as transformations of a streaming frame with `ts` (timestamp), and a runner for bounded replays."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from driftline.session import checkpointed, remove, shared_folder


def scratch(spark: SparkSession) -> str:
    """A new folder in the shared one."""
    return f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"


def replay(frame: DataFrame) -> DataFrame:
    """All that is available now, run to its end in append mode and read back."""
    spark = frame.sparkSession
    folder = scratch(spark)
    query = frame.writeStream.format("parquet").outputMode("append").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return kept(spark.read.schema(frame.schema).parquet(f"{folder}/out"), folder)


def kept(rows: DataFrame, folder: str) -> DataFrame:
    """Rows of a replay's folder as a checkpoint of their own, which goes with them; the folder goes now."""
    rows = checkpointed(rows)
    remove(rows.sparkSession, folder)
    return rows


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    raw = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return raw.select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", "value")


def deduplicated(frame: DataFrame, keys: list[str], keep: str = "48 hours") -> DataFrame:
    """First row of each key within the watermark; the state of a key ends with it."""
    return frame.withWatermark("ts", keep).dropDuplicatesWithinWatermark(keys)


def candles(frame: DataFrame, width: str, late: str = "0 seconds") -> DataFrame:
    """Closed bars only: a window leaves the state once the watermark has passed its end."""
    price = F.col("value") + 1
    order = F.struct("ts", "event_id")
    bars = frame.withWatermark("ts", late).groupBy(F.window("ts", width)).agg(
        F.min_by(price, order).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, order).alias("close"),
        F.sum(F.col("value").cast("decimal(18,2)")).cast("double").alias("volume"), F.count(F.lit(1)).alias("trades"),
    )
    return bars.select(F.unix_millis("window.start").alias("at"), "open", "high", "low", "close", "volume", "trades")


def flow(frame: DataFrame, length: str, step: str, late: str = "0 seconds") -> DataFrame:
    """Buy and sell USD of sliding windows."""
    buy = F.col("event_type").isin("purchase", "signup", "click")
    usd = F.col("value").cast("decimal(18,2)")
    w = frame.withWatermark("ts", late).groupBy(F.window("ts", length, step)).agg(F.coalesce(F.sum(F.when(buy, usd)), F.lit(0)).cast("double").alias("buy_usd"), F.coalesce(F.sum(F.when(~buy, usd)), F.lit(0)).cast("double").alias("sell_usd"))
    return w.select(F.unix_millis("window.start").alias("at"), "buy_usd", "sell_usd")


def silences(frame: DataFrame, key: str, gap: str, late: str = "0 seconds") -> DataFrame:
    """Sessions of a key that `gap` of silence has ended."""
    s = frame.withWatermark("ts", late).groupBy(F.session_window("ts", gap), key).agg(F.count(F.lit(1)).alias("n"))
    return s.select(key, F.unix_millis("session_window.start").alias("start"), F.unix_millis("session_window.end").alias("stop"), "n")


def first_hits(frame: DataFrame, key: str, stop: float, target: float) -> DataFrame:
    """key, at (ms), first_hit (stop or target): once a key, when its price first reaches a multiple of its first price.

    The state of a key is its first price and whether it is done, whatever the number of its rows.
    """

    def advance(of: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        price = rows["value"].to_numpy(float) + 1
        entry, done = state.get if state.exists else (float(price[0]), False)
        reached = np.flatnonzero((price <= entry * stop) | (price >= entry * target))
        if len(reached) and not done:
            at = reached[0]
            yield pd.DataFrame({key: [of[0]], "at": [rows["ts"].iloc[at].value // 1_000_000], "first_hit": ["stop" if price[at] <= entry * stop else "target"]})
            done = True
        state.update((entry, done))

    kind = frame.schema[key].dataType.simpleString()
    return frame.groupBy(key).applyInPandasWithState(advance, f"{key} {kind}, at long, first_hit string", "entry double, done boolean", "append", GroupStateTimeout.NoTimeout)
