"""Time joins: as-of, forward, nearest, range and interval overlap.

Range joins get an equi-key from time buckets, so they are hash or sort-merge joins on
(key, bucket), never nested loops; the as-of join is one window over a union, with no join at all.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def asof_join(left: DataFrame, right: DataFrame, keys: list[str], values: list[str], lag: int = 0, left_at: str = "at", right_at: str = "at") -> DataFrame:
    """`left` with the `values` of the last right row of its key at or before left_at - lag (null if none). Equal right times: the greatest values."""
    one = left.select(*keys, (F.col(left_at) - lag).alias("__t"), F.lit(1).alias("__side"), F.struct(*left.columns).alias("__l"), F.lit(None).cast(right.select(F.struct(*values)).schema[0].dataType).alias("__r"))
    two = right.select(*keys, F.col(right_at).alias("__t"), F.lit(0).alias("__side"), F.lit(None).cast(left.select(F.struct(*left.columns)).schema[0].dataType).alias("__l"), F.struct(*values).alias("__r"))
    order = Window.partitionBy(*keys).orderBy("__t", "__side", "__r").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    filled = one.unionByName(two).select("*", F.last("__r", ignorenulls=True).over(order).alias("__found"))
    return filled.where("__side = 1").select("__l.*", *[F.col("__found")[v].alias(v) for v in values])


def range_join(left: DataFrame, right: DataFrame, keys: list[str], length: int, left_at: str = "at", right_at: str = "at", how: str = "inner") -> DataFrame:
    """Pairs with right_at in [left_at, left_at + length); right's columns other than keys come as struct r. Left rows go to the two buckets their range touches."""
    bucket = lambda c: F.expr(f"{c} div {length}")
    wide = left.select("*", F.explode(F.array(bucket(left_at), bucket(left_at) + 1)).alias("__b"))
    narrow = right.select(*keys, bucket(right_at).alias("__b"), F.struct(*[c for c in right.columns if c not in keys]).alias("r"))
    found = wide.join(narrow, [*keys, "__b"]).where((F.col(f"r.{right_at}") >= F.col(left_at)) & (F.col(f"r.{right_at}") < F.col(left_at) + length)).drop("__b")
    return found.select(*left.columns, "r")


def neighbour(left: DataFrame, right: DataFrame, keys: list[str], value: str, later: bool, left_at: str = "at", right_at: str = "at") -> DataFrame:
    """`left` with __near (at, value) of the first right row of its key at or after its time (`later`), or of the last at or before it.

    One window over both sides in time order, whatever the density of a key; of equal right times the least value.
    """
    kind = right.select(F.struct(F.col(right_at).alias("at"), F.col(value).alias("value"))).schema[0].dataType
    sign = 1 if later else -1
    one = left.select(*keys, (sign * F.col(left_at)).alias("__t"), F.lit(0).alias("__side"), F.struct(*left.columns).alias("__l"), F.lit(None).cast(kind).alias("__r"))
    right = right.groupBy(*keys, F.col(right_at).alias("__at")).agg(F.min(value).alias("__value"))
    two = right.select(*keys, (sign * F.col("__at")).alias("__t"), F.lit(1).alias("__side"), F.lit(None).cast(left.select(F.struct(*left.columns)).schema[0].dataType).alias("__l"), F.struct(F.col("__at").alias("at"), F.col("__value").alias("value")).alias("__r"))
    # in descending order right rows of the same time come before left ones
    ahead = Window.partitionBy(*keys).orderBy(F.col("__t").desc(), F.col("__side").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = one.unionByName(two).select("*", F.last("__r", ignorenulls=True).over(ahead).alias("__near"))
    return found.where("__side = 0").select("__l.*", "__near")


def first_at_or_after(left: DataFrame, right: DataFrame, keys: list[str], identity: str, value: str, within: int, left_at: str = "at", right_at: str = "at") -> DataFrame:
    """identity and the value of the first right row in [left_at, left_at + within); rows without one are left out."""
    found = neighbour(left, right, keys, value, True, left_at, right_at)
    return found.where(F.col("__near.at") < F.col(left_at) + within).select(identity, F.col("__near.value").alias(value))


def nearest(left: DataFrame, right: DataFrame, keys: list[str], identity: str, value: str, within: int) -> DataFrame:
    """identity and the value of the right row closest in time, within +-`within` ms; ties: the earlier, then the smaller value. Rows without one are left out."""
    after = neighbour(left.select(*keys, identity, "at"), right, keys, value, True).withColumnRenamed("__near", "__after")
    both = neighbour(after, right, keys, value, False)
    gap = lambda c: F.abs(F.col(f"{c}.at") - F.col("at"))
    earlier = F.col("__near").isNotNull() & (F.col("__after").isNull() | (gap("__near") <= gap("__after")))
    chosen = both.select(identity, "at", F.when(earlier, F.col("__near")).otherwise(F.col("__after")).alias("c"))
    return chosen.where(F.abs(F.col("c.at") - F.col("at")) <= within).select(identity, F.col("c.value").alias(value))


def overlaps(spans: DataFrame, gaps: DataFrame, key: str, identity: str, length: int) -> DataFrame:
    """Identities of spans [start, stop) that a gap [since, until) of their key overlaps; both shorter than `length` ms."""
    buckets = lambda a, b: F.sequence(F.expr(f"{a} div {length}"), F.expr(f"{b} div {length}"))
    left = spans.select(identity, key, "start", "stop", F.explode(buckets("start", "stop")).alias("__b"))
    right = gaps.select(key, "since", "until", F.explode(buckets("since", "until")).alias("__b"))
    return left.join(right, [key, "__b"]).where("since < stop AND until > start").select(identity).distinct()


def pending(left: DataFrame, right: DataFrame, key: str, done: str) -> DataFrame:
    """Left rows without a right row, or with one that is not done."""
    return left.join(right, key, "left").where(F.col(done).isNull() | ~F.col(done))


def theta_cohort(observations: DataFrame, registry: DataFrame) -> DataFrame:
    """Observations with each variant whose lock time they do not precede; the registry is a handful of configured rows."""
    return observations.join(F.broadcast(registry), F.col("at") >= F.col("locked_at"))


def duplicates_within(rows: DataFrame, key: str, identity: str, length: int) -> DataFrame:
    """Rows with another row of the key less than `length` ms away: the neighbours in time decide, no self-join."""
    order = Window.partitionBy(key).orderBy("at", identity)
    before, after = F.col("at") - F.lag("at").over(order), F.lead("at").over(order) - F.col("at")
    return rows.select(identity, F.coalesce(before < length, F.lit(False)).alias("a"), F.coalesce(after < length, F.lit(False)).alias("b")).where("a OR b").select(identity)
