"""Evidence that must be complete before a rule's messages are let out: observation, acceptance, no duplicates."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftline.operators import screening
from driftline.operators.joins import duplicates_within

MINUTE = 60_000
DAY = 24 * 60 * MINUTE


@dataclass(frozen=True)
class Evidence:
    """Fixed values of the gates: days observed, slots (minutes) that may be missing, the longest gap, when a review and a sample count, what they must show."""

    span: int = 7 * DAY
    slot: int = MINUTE
    missing: int = 14
    gap: int = 3 * MINUTE
    after: int = MINUTE
    before: int = 2 * MINUTE
    order_usd: float = 100.0
    impact: float = 2.0
    liquidity: float = 50_000.0
    kept: float = 0.9
    accepted: float = 0.9
    apart: int = DAY


def accepted(references: DataFrame, reviews: DataFrame, samples: DataFrame, rules: Evidence) -> DataFrame:
    """scope, passed, total of references (scope, id, at, liquidity) that a review and the first sample in the window after them bear out; what is missing counts as failed."""
    inside = lambda c: (F.col(c) >= F.col("at") + rules.after) & (F.col(c) <= F.col("at") + rules.before)
    seen = references.join(samples.select("id", F.col("at").alias("s_at"), F.col("liquidity").alias("s_liquidity")), "id").where(inside("s_at"))
    first = seen.groupBy("scope", "id").agg(F.min_by("s_liquidity", F.struct("s_at", "s_liquidity")).alias("seen"))
    read = reviews.groupBy("id").agg(F.min(F.struct("checked_at", "order_usd", "impact")).alias("r")).select("id", "r.*")
    both = references.join(read, "id", "left").join(first, ["scope", "id"], "left")
    fine = inside("checked_at") & (F.col("order_usd") == rules.order_usd) & (F.col("impact") <= rules.impact) & (F.col("seen") >= rules.liquidity) & (F.col("seen") >= F.col("liquidity") * rules.kept)
    return both.groupBy("scope").agg(F.count_if(F.coalesce(fine, F.lit(False))).alias("passed"), F.count(F.lit(1)).alias("total"))


def evidence(started: DataFrame, slots: DataFrame, references: DataFrame, reviews: DataFrame, samples: DataFrame, sent: DataFrame, now: int, rules: Evidence = Evidence()) -> DataFrame:
    """scope, slots, widest (gap), passed, total, blockers (in order) and approved of each scope of `started` (scope, started_at).

    slots: scope, at; sent: scope, token, id, at; see `accepted` for the others. Each side is one
    aggregate a scope; times of a scope's slots are one window, and at most span / slot rows each.
    References younger than a full window have no part. A second review of a reference blocks its scope.
    """
    recent = slots.where((F.col("at") >= now - rules.span) & (F.col("at") <= now)).select("scope", (F.expr(f"at div {rules.slot}") * rules.slot).alias("at")).distinct()
    gaps = recent.select("scope", (F.col("at") - F.lag("at").over(Window.partitionBy("scope").orderBy("at"))).alias("gap"))
    observed = gaps.groupBy("scope").agg(F.count(F.lit(1)).alias("slots"), F.max("gap").alias("widest"))
    mature = references.where((F.col("at") >= now - rules.span) & (F.col("at") <= now - rules.before))
    twice = mature.join(reviews.groupBy("id").count().where("count > 1"), "id").select("scope").distinct().withColumn("twice", F.lit(True))
    keyed = sent.withColumn("__key", F.concat_ws("|", F.coalesce(F.col("scope").cast("string"), F.lit("<none>")), "token"))
    again = keyed.join(duplicates_within(keyed.select("__key", "id", "at"), "__key", "id", rules.apart), "id", "left_semi").select("scope").distinct().withColumn("again", F.lit(True))
    all_of = started.join(observed, "scope", "left").join(accepted(mature, reviews, samples, rules), "scope", "left").join(twice, "scope", "left").join(again, "scope", "left")
    slots_needed = rules.span // rules.slot - rules.missing
    blockers = screening.reasons([
        ("days", F.coalesce(F.lit(now) - F.col("started_at") < rules.span, F.lit(True))), ("coverage", F.coalesce(F.col("slots"), F.lit(0)) < slots_needed), ("gap", F.col("widest") > rules.gap), ("candidates", F.coalesce(F.col("total"), F.lit(0)) == 0),
        ("reviews", F.col("twice")), ("acceptance", F.col("passed") / F.col("total") < rules.accepted), ("duplicates", F.col("again")),
    ])
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    told = all_of.select("scope", zero("slots"), F.coalesce("widest", F.lit(0)).cast("long").alias("widest"), zero("passed"), zero("total"), blockers.alias("blockers"))
    return told.withColumn("approved", F.size("blockers") == 0)
