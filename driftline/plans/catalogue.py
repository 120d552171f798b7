"""Every query of the event-study operators, each with its DuckDB SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.operators import timeseries as ts
from driftline.plans import families, providers, reports, research, series, states, studies
from driftline.plans.registry import Query
from driftline.plans.views import BAR, bars


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Indicators of every bar in each key's newest run without a hole."""
    keys = ["chain"]
    tail = ts.ema(ts.contiguous_tail(bars(spark, sf_dir), keys, BAR), keys, {"ema9": 9, "ema21": 21})
    ranged = ts.atr(tail, keys)
    return ts.body_features(ranged.select("*", ts.sma("close", keys, 50).alias("sma50"), ts.volume_ratio(keys).alias("volume_ratio"), ts.drawdown(keys).alias("drawdown"), ts.slope("ema9", keys).alias("ema9_slope"))).drop("true_range").where(F.col("at").isNotNull())


def queries() -> dict[str, Query]:
    return series.reg.queries | studies.reg.queries | research.reg.queries | reports.reg.queries | states.reg.queries | providers.reg.queries | families.reg.queries | {"flagship": flagship}


def oracle_sql() -> dict[str, str]:
    return series.reg.sql | studies.reg.sql | research.reg.sql | reports.reg.sql | states.reg.sql | providers.reg.sql | families.reg.sql
