"""Intervals of classification metrics by resampling days: replicates are weights of days, never copies of rows.

Rows are first counted by (model, score, day). Counts are dealt by ranges of the score and read
twice in descending order: for each range's totals, then, with what lies above a range known, for
its part of the rank metrics of all replicates at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftline.operators import newton
from driftline.operators.resample import draws
from driftline.session import checkpointed

METRICS = ("log_loss", "brier", "roc_auc", "pr_auc")
#: Ranges of scores: of each and each model two numbers a replicate reach the driver.
RANGES = 64
#: Counts times replicates that a task works on at once.
CELLS = 2_000_000


def weights(seed: int, reps: int, days: int) -> np.ndarray:
    """(reps + 1, days): how often each replicate has each day; the first row is the data as it is."""
    out = np.ones((reps + 1, days), np.int64)
    place = np.arange(days)
    for rep in range(reps):
        out[rep + 1] = np.bincount(draws(seed, np.array(rep), place) % days, minlength=days)
    return out


def ranked(counts: DataFrame) -> DataFrame:
    """model, p, i, pos, neg in ranges of descending score; rows of a model and score are in one range."""
    order = ["model", F.desc("p")]
    dealt = counts.repartitionByRange(RANGES, *order).withColumn("part", F.spark_partition_id())
    return checkpointed(dealt).sortWithinPartitions(*order)  # ranges are sampled, so both passes must see the same ones


def scores(batches: Iterator[pa.RecordBatch], w: np.ndarray) -> Iterator[tuple[str, int, np.ndarray, np.ndarray]]:
    """model, part, positives and negatives (distinct scores x replicates) in runs of whole scores, bounded in size."""
    step = max(1, CELLS // len(w))
    held: list[dict] = []

    def runs(last: bool) -> Iterator[tuple[str, int, np.ndarray, np.ndarray]]:
        nonlocal held
        cut = len(held)
        if not last:
            while cut and (held[cut - 1]["model"], held[cut - 1]["p"]) == (held[-1]["model"], held[-1]["p"]):
                cut -= 1
        at = 0
        while at < cut:
            model, end = held[at]["model"], at
            while end < cut and held[end]["model"] == model and (end - at < step or held[end]["p"] == held[end - 1]["p"]):
                end += 1
            rows = held[at:end]
            first = [k for k, r in enumerate(rows) if k == 0 or r["p"] != rows[k - 1]["p"]]
            by = w[:, [r["i"] for r in rows]].T
            pos, neg = (np.add.reduceat(by * np.array([r[c] for r in rows])[:, None], first, axis=0) for c in ("pos", "neg"))
            yield model, rows[0]["part"], pos, neg
            at = end
        held = held[cut:]

    for batch in batches:
        held += batch.to_pylist()
        if len(held) >= step:
            yield from runs(False)
    yield from runs(True)


def totals(w: np.ndarray):
    """A function to (model, part, pos, neg): each range's sums of all replicates."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[str, int], list[np.ndarray]] = {}
        for model, part, pos, neg in scores(batches, w):
            got = sums.setdefault((model, part), [np.zeros(len(w), np.int64), np.zeros(len(w), np.int64)])
            got[0] += pos.sum(0)
            got[1] += neg.sum(0)
        for (model, part), (pos, neg) in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([model]), pa.array([part], pa.int32()), pa.array([pos]), pa.array([neg])], names=["model", "part", "pos", "neg"])

    return run


def rank_parts(w: np.ndarray, above: dict[tuple[str, int], tuple[np.ndarray, np.ndarray]], whole: dict[str, tuple[np.ndarray, np.ndarray]]):
    """A function to (model, rep, auc, ap): each range's share of both areas."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        areas: dict[str, np.ndarray] = {}
        up: dict[str, list[np.ndarray]] = {}
        for model, part, pos, neg in scores(batches, w):
            p0, n0 = up.setdefault(model, [x.copy() for x in above[model, part]])
            all_pos, all_neg = whole[model]
            tp, fp = p0 + pos.cumsum(0), n0 + neg.cumsum(0)
            area = areas.setdefault(model, np.zeros((2, len(w))))
            with np.errstate(divide="ignore", invalid="ignore"):
                area[0] += (pos * (all_neg - fp + neg / 2)).sum(0) / (all_pos * all_neg)
                area[1] += np.where(pos > 0, pos * tp / np.maximum(tp + fp, 1), 0).sum(0) / all_pos
            up[model] = [tp[-1], fp[-1]]
        for model, (auc, ap) in areas.items():
            yield pa.RecordBatch.from_arrays([pa.array([model] * len(w)), pa.array(range(-1, len(w) - 1), pa.int32()), pa.array(auc), pa.array(ap)], names=["model", "rep", "roc_auc", "pr_auc"])

    return run


def loss_parts(w: np.ndarray):
    """A function from (model, i, n, log_loss, brier) by days to (model, rep, n, log_loss, brier) sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for r in batch.to_pylist():
                got = sums.setdefault(r["model"], np.zeros((3, len(w))))
                got += w[:, r["i"]] * np.array([r["n"], r["log_loss"], r["brier"]])[:, None]
        for model, (n, a, b) in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([model] * len(w)), pa.array(range(-1, len(w) - 1), pa.int32()), *(pa.array(x) for x in (n, a, b))], names=["model", "rep", "n", "log_loss", "brier"])

    return run


def replicates(rows: DataFrame, reps: int, seed: int) -> DataFrame:
    """model, rep, and each metric (null where a class is missing); rep -1 is the data as it is. rows: model, y, p, day.

    Rows whose y is neither 0 nor 1 or whose p or day is null take no part. Days, a few thousand at
    most, are numbered on the driver.
    """
    fine = rows.where("y IN (0, 1) AND p IS NOT NULL AND day IS NOT NULL AND NOT isnan(p)").select(F.col("model").cast("string").alias("model"), F.col("y").cast("long").alias("y"), F.col("p").cast("double").alias("p"), "day")
    days = [r[0] for r in fine.select("day").distinct().orderBy("day").collect()]
    w = weights(seed, reps, len(days)) if days else np.ones((reps + 1, 0), np.int64)
    number = fine.sparkSession.createDataFrame(list(enumerate(days)), f"i int, day {fine.schema['day'].dataType.simpleString()}")
    numbered = fine.join(F.broadcast(number), "day")
    counts = ranked(numbered.groupBy("model", "p", "i").agg(F.sum("y").alias("pos"), F.sum(1 - F.col("y")).alias("neg")))
    found = counts.mapInArrow(totals(w), "model string, part int, pos array<long>, neg array<long>").collect()  # RANGES rows a model
    above, whole = {}, {}
    for r in sorted(found, key=lambda r: (r["model"], r["part"])):
        before = whole.setdefault(r["model"], (np.zeros(len(w), np.int64), np.zeros(len(w), np.int64)))
        above[r["model"], r["part"]] = before
        whole[r["model"]] = (before[0] + np.array(r["pos"]), before[1] + np.array(r["neg"]))
    ranks = counts.mapInArrow(rank_parts(w, above, whole), "model string, rep int, roc_auc double, pr_auc double").groupBy("model", "rep").agg(*[F.sum(c).alias(c) for c in ("roc_auc", "pr_auc")])
    q = F.least(F.greatest("p", F.lit(1e-8)), F.lit(1 - 1e-8))
    loss = numbered.groupBy("model", "i").agg(F.count(F.lit(1)).alias("n"), F.sum(-F.when(F.col("y") == 1, F.log(q)).otherwise(F.log(1 - q))).alias("log_loss"), F.sum((F.col("p") - F.col("y")) * (F.col("p") - F.col("y"))).alias("brier"))
    losses = loss.mapInArrow(loss_parts(w), "model string, rep int, n double, log_loss double, brier double").groupBy("model", "rep").agg(*[(F.sum(c) / F.nullif(F.sum("n"), F.lit(0.0))).alias(c) for c in ("log_loss", "brier")])
    return losses.join(ranks, ["model", "rep"]).select("model", "rep", *[F.nanvl(c, F.lit(None).cast("double")).alias(c) for c in METRICS])


def long(reps: DataFrame) -> DataFrame:
    return reps.unpivot(["model", "rep"], list(METRICS), "metric", "value")


def ends(values: DataFrame, keys: list[str]) -> DataFrame:
    """keys, estimate, low and high (2.5 and 97.5 % of the replicates that have a value)."""
    again = F.when(F.col("rep") >= 0, F.col("value"))
    return values.groupBy(*keys).agg(F.max(F.when(F.col("rep") < 0, F.col("value"))).alias("estimate"), F.percentile(again, F.lit(0.025)).alias("low"), F.percentile(again, F.lit(0.975)).alias("high"))


def metric_intervals(rows: DataFrame, reps: int = 1_000, seed: int = 1) -> DataFrame:
    """model, metric, estimate, low, high of log loss, Brier, ROC AUC and average precision. rows: model, y, p, day."""
    return ends(long(replicates(rows, reps, seed)), ["model", "metric"])


def paired_differences(rows: DataFrame, left: str, right: str, reps: int = 1_000, seed: int = 1, least_days: int = 3, least_rows: int = 20) -> DataFrame:
    """metric, left, right, difference, low, high of two columns of predictions over the rows that have both, replicates sharing their days.

    Below `least_days` days or `least_rows` rows low and high are null. rows: y, day and both columns.
    """
    both = rows.where(F.col("y").isin(0, 1) & F.col(left).isNotNull() & F.col(right).isNotNull() & F.col("day").isNotNull())
    models = both.select("y", "day", F.explode(F.array(F.struct(F.lit("l").alias("model"), F.col(left).cast("double").alias("p")), F.struct(F.lit("r").alias("model"), F.col(right).cast("double").alias("p")))).alias("m"))
    values = long(replicates(models.select("m.model", "y", "m.p", "day"), reps, seed)).groupBy("metric", "rep").pivot("model", ["l", "r"]).agg(F.first("value"))
    found = ends(values.select("metric", "rep", (F.col("l") - F.col("r")).alias("value")), ["metric"])
    sides = values.where("rep = -1").select("metric", F.col("l").alias("left"), F.col("r").alias("right"))
    support = F.broadcast(both.agg(F.count_distinct("day").alias("days"), F.count(F.lit(1)).alias("rows")))  # one row
    enough = (F.col("days") >= least_days) & (F.col("rows") >= least_rows)
    told = sides.join(found, "metric").join(support)
    return told.select("metric", "left", "right", F.col("estimate").alias("difference"), *[F.when(enough, F.col(c)).alias(c) for c in ("low", "high")], "days", "rows")


def coefficients(rows: DataFrame, features: list[str], c: float = 1.0, reps: int = 1_000, seed: int = 1) -> DataFrame:
    """feature, coefficient, low, high of a logistic regression with ridge penalty 1 / c on scaled features, refitted to resampled days.

    All replicates take Newton steps together: a round is one pass over the rows, those alike in day,
    label and features as one with a weight, whose gradients and Hessians are summed by tasks; the driver solves a small system a replicate. Every replicate scales by its own
    spread. Missing features are filled with the whole table's median. rows: y, day and the features;
    rows whose y is neither 0 nor 1 or whose day is null take no part; without rows there are none.
    """
    spark = rows.sparkSession
    fine = rows.where("y IN (0, 1) AND day IS NOT NULL").select("day", F.col("y").cast("double").alias("y"), *[F.col(f).cast("double").alias(f) for f in features])
    medians = fine.agg(*[F.percentile(f, F.lit(0.5)).alias(f) for f in features]).first()
    days = [r[0] for r in fine.select("day").distinct().orderBy("day").collect()]
    schema = "feature string, coefficient double, low double, high double"
    if not days:
        return spark.createDataFrame([], schema)
    number = spark.createDataFrame(list(enumerate(days)), f"i int, day {fine.schema['day'].dataType.simpleString()}")
    filled = fine.join(F.broadcast(number), "day").select("i", "y", *[F.coalesce(F.nanvl(f, F.lit(None).cast("double")), F.lit(medians[f] or 0.0)).alias(f) for f in features])
    alike = checkpointed(filled.groupBy("i", "y", *features).agg(F.count(F.lit(1)).alias("__rows")))
    w = weights(seed, reps, len(days))
    found = newton.fit(alike, features, lambda batch: w[:, batch.column("i").to_numpy()] * batch.column("__rows").to_numpy(), len(w), 1 / c)
    drawn = found.beta[1:, :-1][found.usable[1:]]
    low, high = (np.quantile(drawn, q, axis=0) if len(drawn) else np.full(len(features), np.nan) for q in (0.025, 0.975))
    return spark.createDataFrame([(f, float(found.beta[0, j]), *(None if np.isnan(x[j]) else float(x[j]) for x in (low, high))) for j, f in enumerate(features)], schema)
