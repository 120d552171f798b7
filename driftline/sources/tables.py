"""Checked scans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def csv(spark: SparkSession, path: str, required: list[str], optional: list[str] = (), numeric: list[str] = (), boolean: list[str] = ()) -> DataFrame:
    """A CSV (gzip included) with a header: missing required columns raise, missing optional ones are null, numbers and flags that do not parse are null."""
    raw = spark.read.csv(path, header=True, inferSchema=False, escape='"', multiLine=False)
    missing = [c for c in required if c not in raw.columns]
    if missing:
        raise ValueError(f"{path}: no columns {', '.join(missing)}")
    kind = lambda c: "double" if c in numeric else "boolean" if c in boolean else "string"
    return raw.select(*[(F.col(c) if c in raw.columns else F.lit(None).cast("string")).try_cast(kind(c)).alias(c) for c in [*required, *optional]])


def json_bars(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Bars from a folder of JSON files {key, rows: [[at, open, high, low, close, volume], ...]}, one record a file or, with `lines`, one a line.

    A record without rows, a row that has not six numbers and text that does not parse end the scan with an error.
    """
    raw = spark.read.schema("key string, rows array<array<double>>").json(path, multiLine=not lines, mode="FAILFAST")
    wrong = lambda kind: F.raise_error(F.concat(F.lit("a bar of "), F.coalesce("key", F.lit("an unnamed key")), F.lit(" has not six numbers"))).cast(kind)
    r = raw.select("key", F.explode(F.coalesce("rows", wrong("array<array<double>>"))).alias("r"))
    fine = F.coalesce((F.size("r") == 6) & ~F.exists("r", lambda x: x.isNull()), F.lit(False))
    r = r.select("key", F.when(fine, F.col("r")).otherwise(wrong("array<double>")).alias("r"))
    return r.select("key", F.col("r")[0].cast("long").alias("at"), *[F.col("r")[i].alias(n) for i, n in enumerate(("open", "high", "low", "close", "volume"), 1)])


def fresh(rows: DataFrame, now: int, within: int = 120_000, n: int = 100, order: list[str] = ()) -> DataFrame:
    """The latest n rows of the last `within` ms; `order` settles ties."""
    return rows.where((F.col("at") > now - within) & (F.col("at") <= now)).orderBy(F.col("at").desc(), *order).limit(n)


def synthetic(spark: SparkSession, n: int = 600) -> DataFrame:
    """Observations 4 h apart, every fifth a control, with a weak signal in volume_ratio: deterministic by id."""
    u = lambda salt: F.pmod(F.xxhash64(F.lit(salt), F.col("id")), F.lit(1_000_000)) / 1_000_000.0
    base = spark.range(n).select(F.col("id"), (F.col("id") * 14_400_000).alias("at"), F.expr("id div 3").cast("string").alias("token"), (F.col("id") % 5 == 0).alias("control"), (1 + 2 * u("v")).alias("volume_ratio"), (u("r") * 10).alias("risk_pct"))
    return base.select("*", (u("y") < 0.3 + 0.2 * (F.col("volume_ratio") - 1) / 2).cast("int").alias("y"))
