"""State kept over time: upserts, claims, caps, transitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def seen(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.min("at").alias("first_seen"), F.max("at").alias("last_seen"))


def merge_seen(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Least first and greatest last time of both tables; associative, so any number of batches can be merged."""
    return old.unionByName(new).groupBy(*keys).agg(F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"))


def insert_ignore(old: DataFrame, batch: DataFrame, keys: list[str], order: str) -> DataFrame:
    """`old` and, for each key it lacks, the batch's first row by `order`."""
    others = [c for c in batch.columns if c not in keys]
    first = batch.groupBy(*keys).agg(F.min_by(F.struct(*others), order).alias("s")).select(*keys, "s.*")
    return old.unionByName(first.join(old, keys, "left_anti"))


def upsert(old: DataFrame, batch: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last row of each key by `order` in either table."""
    both = old.unionByName(batch)
    others = [c for c in both.columns if c not in keys]
    return both.groupBy(*keys).agg(F.max_by(F.struct(*others), order).alias("s")).select(*keys, "s.*")


def latest(rows: DataFrame, keys: list[str], order: Column) -> DataFrame:
    others = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*others), order).alias("s")).select(*keys, "s.*")


def rolling_usage(rows: DataFrame, keys: list[str], length: int) -> Column:
    """Rows of the key in (at - length, at], the row itself included."""
    return F.count(F.lit(1)).over(Window.partitionBy(*keys).orderBy("at").rangeBetween(-length + 1, 0))


def transitions(rows: DataFrame, keys: list[str], state: str) -> DataFrame:
    """Runs of equal state: state, since, until (last time seen), rows."""
    order = Window.partitionBy(*keys).orderBy("at", "id")
    changed = F.coalesce((F.col(state) != F.lag(state).over(order)).cast("int"), F.lit(1))
    runs = rows.select(*keys, "at", "id", state, changed.alias("c")).select("*", F.sum("c").over(order).alias("run"))
    return runs.groupBy(*keys, "run").agg(F.first(state).alias(state), F.min("at").alias("since"), F.max("at").alias("until"), F.count(F.lit(1)).alias("n")).drop("run")


def sessions(rows: DataFrame, keys: list[str], silence: int) -> DataFrame:
    """Sessions ended by more than `silence` ms without a row."""
    order = Window.partitionBy(*keys).orderBy("at")
    new = F.coalesce((F.col("at") - F.lag("at").over(order) > silence).cast("int"), F.lit(1))
    marked = rows.select(*keys, "at", new.alias("new")).select("*", F.sum("new").over(order).alias("s"))
    return marked.groupBy(*keys, "s").agg(F.min("at").alias("start"), F.max("at").alias("stop"), F.count(F.lit(1)).alias("n")).drop("s")


def hysteresis(rows: DataFrame, keys: list[str], value: str, high: float, low: float) -> DataFrame:
    """Adds paused: set at `high` or above, cleared below `low`, else as before (false at first). The last decisive value tells, so it is one window."""
    order = Window.partitionBy(*keys).orderBy("at", "id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    decisive = F.when(F.col(value) >= high, F.lit(True)).when(F.col(value) < low, F.lit(False))
    return rows.select("*", F.coalesce(F.last(decisive, ignorenulls=True).over(order), F.lit(False)).alias("paused"))


def high_water(keys: list[str], value: str, give_back: float) -> tuple[Column, Column]:
    """Running maximum, and the stop that trails it."""
    peak = F.max(value).over(Window.partitionBy(*keys).orderBy("at", "id").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return peak, peak * (1 - give_back)


def merge_fields(rows: DataFrame, keys: list[str], order: str, latest: list[str], earliest: list[str]) -> DataFrame:
    """Per key the last known value of each field in `latest`, and the first of each in `earliest`; partial aggregates only."""
    last = [F.max_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in latest]
    return rows.groupBy(*keys).agg(*last, *[F.min_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in earliest])


def transition(rows: DataFrame, states: list[str], to: str, guard: Column) -> DataFrame:
    """Rows in one of the states move to another if the guard holds; nothing else changes."""
    return rows.withColumn("status", F.when(F.col("status").isin(states) & guard, F.lit(to)).otherwise(F.col("status")))


def retained(rows: DataFrame, at: str, now: int, length: int) -> DataFrame:
    """Rows no older than `length`; a bound on a column of the scan, so that whole files are skipped."""
    return rows.where(F.col(at) >= now - length)


def bisected(rows: DataFrame, identity: str, at: str, span: int, most: int, depth: int) -> DataFrame:
    """identity, level, part, saturated: the first halving of `span` after which a row's range has `most` rows at most.

    Rows of ranges that stay fuller after `depth` halvings are in the last one and saturated: a
    source that answers with `most` rows at a time has not told all of them, and `complete` raises.
    A range's rows are counted map-side at every level; a row then meets its ranges' counts. Rows
    with a null time take no part.
    """
    lo = F.broadcast(rows.agg(F.min(at).alias("__lo")))  # one row
    levels = rows.where(F.col(at).isNotNull()).join(lo).select(identity, F.col(at).alias("__at"), "__lo", F.explode(F.sequence(F.lit(0), F.lit(depth))).alias("level"))
    placed = levels.select(identity, "level", F.expr(f"(__at - __lo) div ({span} div shiftleft(1, level))").alias("part"))
    counted = placed.groupBy("level", "part").agg(F.count(F.lit(1)).alias("n"))
    final = counted.where((F.col("n") <= most) | (F.col("level") == depth)).withColumn("saturated", F.col("n") > most)
    return placed.join(final, ["level", "part"]).groupBy(identity).agg(F.min(F.struct("level", "part", "saturated")).alias("s")).select(identity, "s.level", "s.part", "s.saturated")


def complete(ranges: DataFrame) -> DataFrame:
    """Ranges of `bisected`, none of them saturated; else reading them ends with an error."""
    return ranges.where(F.when(F.col("saturated"), F.raise_error(F.lit("a range is saturated at the last halving")).cast("boolean")).otherwise(F.lit(True)))
