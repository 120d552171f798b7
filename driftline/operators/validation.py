"""Purged, embargoed, grouped walk-forward folds."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Fold:
    number: int
    start: int
    end: int
    train_rows: int
    test_rows: int


def blocks(rows: DataFrame, group: str, at: str, k: int) -> DataFrame:
    """Adds block: groups in order of first and last time, cut into at most k blocks of equal size, the first ones one group larger."""
    spans = rows.groupBy(group).agg(F.min(at).alias("__a"), F.max(at).alias("__b"))
    order = Window.orderBy("__a", "__b", group)
    everything = Window.partitionBy()
    i, n = F.row_number().over(order) - 1, F.count(F.lit(1)).over(everything)
    placed = spans.select(group, i.alias("i"), n.alias("n")).select("*", F.least(F.lit(k), F.col("n")).alias("k"))
    size, extra = F.expr("n div k"), F.col("n") % F.col("k")
    large = extra * (size + 1)
    block = F.when(F.col("i") < large, F.expr("i div (n div k + 1)")).otherwise(extra + F.floor((F.col("i") - large) / size)).cast("int")
    return rows.join(placed.select(group, block.alias("block")), group)


def walk_forward(rows: DataFrame, group: str = "grp", at: str = "at", resolved: str = "resolved_at", label: str = "y", k: int = 6, embargo: int = 0, least: int = 1) -> tuple[DataFrame, list[Fold]]:
    """(fold, id, role) for each accepted fold, and the folds.

    A fold tests one block and trains on earlier blocks' rows detected before its start less the
    embargo and resolved before its start, outside the embargo after each earlier accepted test.
    It is accepted if both sides have `least` rows and both classes; a skipped one adds no
    embargo. The driver holds a row of figures for each of at most k blocks.
    """
    placed = blocks(rows.where(F.col(label).isin(0, 1)), group, at, k)
    bounds = {r["block"]: (r["a"], r["b"]) for r in placed.groupBy("block").agg(F.min(at).alias("a"), F.max(at).alias("b")).collect()}
    accepted: list[Fold] = []
    parts: list[DataFrame] = []
    for number in sorted(bounds)[1:]:
        start, end = bounds[number]
        train: Column = (F.col("block") < number) & (F.col(at) < start - embargo) & (F.col(resolved) < start)
        for fold in accepted:
            train = train & ~((F.col(at) > fold.end) & (F.col(at) <= fold.end + embargo))
        role = F.when(train, "train").when(F.col("block") == number, "test")
        sides = placed.select(role.alias("role"), F.col(label).alias("y"), *[c for c in ("id",) if c in rows.columns]).where("role IS NOT NULL")
        seen = {r["role"]: r for r in sides.groupBy("role").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("y").alias("classes")).collect()}
        if len(seen) < 2 or any(r["n"] < least or r["classes"] < 2 for r in seen.values()):
            continue
        accepted.append(Fold(number, start, end, seen["train"]["n"], seen["test"]["n"]))
        parts.append(sides.select(F.lit(number).alias("fold"), "id", "role"))
    if not parts:
        return placed.select(F.lit(0).alias("fold"), "id", F.lit("").alias("role")).limit(0), []
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out, accepted


def violations(members: DataFrame, rows: DataFrame, group: str = "grp", at: str = "at", resolved: str = "resolved_at", embargo: int = 0) -> DataFrame:
    """One row a fold: train and test rows, groups on both sides, training rows that a sound fold would not have, and whether training ends before the test begins.

    shared_groups, unpurged (resolved at or after the test's start) and embargoed (in the embargo before it) are 0 in a sound fold.
    """
    m = members.join(rows.select("id", group, at, resolved), "id")
    train = F.col("role") == "train"
    sides = m.groupBy("fold", group).agg(F.count_distinct("role").alias("sides")).groupBy("fold").agg(F.count_if(F.col("sides") > 1).alias("shared_groups"))
    starts = m.where(~train).groupBy("fold").agg(F.min(at).alias("start"))  # a row a fold
    found = m.join(starts, "fold").groupBy("fold").agg(
        F.count_if(train).alias("n_train"), F.count_if(~train).alias("n_test"), F.count_if(train & (F.col(resolved) >= F.col("start"))).alias("unpurged"),
        F.count_if(train & (F.col(at) >= F.col("start") - embargo)).alias("embargoed"), (F.max(F.when(train, F.col(at))) < F.min(F.when(~train, F.col(at)))).alias("in_order"),
    )
    return found.join(sides, "fold")


def nested_choice(members: DataFrame, grid: DataFrame, rule: str = "rule", value: str = "net", least: int = 10) -> DataFrame:
    """fold, the rule with the best training mean (ties: first by name), and its mean in training and test."""
    sides = members.join(grid.select("id", rule, value), "id").groupBy("fold", rule).agg(
        F.avg(F.when(F.col("role") == "train", F.col(value))).alias("train_mean"), F.count_if(F.col("role") == "train").alias("n_train"),
        F.avg(F.when(F.col("role") == "test", F.col(value))).alias("test_mean"), F.count_if(F.col("role") == "test").alias("n_test"),
    )
    w = Window.partitionBy("fold").orderBy(F.col("train_mean").desc(), rule)
    return sides.where(F.col("n_train") >= least).select("*", F.row_number().over(w).alias("__r")).where("__r = 1").drop("__r")
