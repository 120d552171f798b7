"""Out-of-fold models: logistic regressions solved together, boosted trees and isotonic fits on MLlib, which differ numerically from other libraries' versions."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import Imputer, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftline.operators import boosting, newton, stats
from driftline.session import checkpointed

#: Penalties tried, the smallest first.
PENALTIES = (0.01, 0.1, 1.0, 10.0)
#: Rows that differ in label and features that a task of boosted trees gets; up to as many MLlib, too, takes thresholds from all of them.
SHARE = 10_000


def pipeline(features: list[str], kind: str = "logistic", c: float = 1.0, n: int = 100) -> Pipeline:
    """Median imputation and a classifier; logistic regression also scales, with the penalty 1 / (c n)."""
    filled = [f"{f}__" for f in features]
    stages = [Imputer(strategy="median", inputCols=features, outputCols=filled), VectorAssembler(inputCols=filled, outputCol="raw__")]
    if kind == "logistic":
        stages += [StandardScaler(withMean=True, inputCol="raw__", outputCol="x__"), LogisticRegression(featuresCol="x__", labelCol="y", regParam=1 / (c * n), standardization=False)]
    else:
        stages += [GBTClassifier(featuresCol="raw__", labelCol="y", maxDepth=2, maxIter=120, stepSize=0.04, seed=1)]
    return Pipeline(stages=stages)


def boosted(train: DataFrame, features: list[str]) -> PipelineModel:
    """Medians and boosted trees of `pipeline(features, "boosting")`; rows that agree in label and filled features are one with their number as its weight.

    Trees see a row by these only, so each round costs by how many of them differ; its jobs have as many tasks as these need, not as the session shuffles by.
    """
    imputer, assembler, trees = pipeline(features, "boosting").getStages()
    medians = imputer.fit(train)
    filled = imputer.getOutputCols()
    weighed = assembler.transform(medians.transform(train).groupBy("y", *filled).agg(F.count(F.lit(1)).cast("double").alias("weight__"))).select("y", "weight__", assembler.getOutputCol()).cache()
    try:
        shares = math.ceil(weighed.count() / SHARE)
        return PipelineModel([medians, assembler, trees.setWeightCol("weight__").fit(weighed.coalesce(max(1, shares)))])
    finally:
        weighed.unpersist()


def sided(rows: DataFrame, members: DataFrame, features: list[str], folds: list[int]) -> tuple[DataFrame, Callable]:
    """id, y and features of the members, met with their folds once, and side(fold, role) of them; a row's sides are a character a fold: 1 train, 2 test, 3 both."""
    code = F.when(F.col("role") == "train", 1).when(F.col("role") == "test", 2)
    sides = members.groupBy("id").agg(F.concat(*[F.coalesce(F.bit_or(F.when(F.col("fold") == k, code)), F.lit(0)).cast("string") for k in folds]).alias("sides__"))
    met = checkpointed(rows.join(sides, "id").select("id", "y", *features, "sides__"))
    return met, lambda fold, role: met.where(F.substring("sides__", folds.index(fold) + 1, 1).isin("3", "1" if role == "train" else "2")).drop("sides__")


def of_each(work: Callable, items: list) -> list:
    """work(item) of each item, side by side, as small jobs of one leave most tasks' places free."""
    with ThreadPoolExecutor(max(1, len(items))) as pool:
        return list(pool.map(inheritable_thread_target(work), items))


def boosters(rows: DataFrame, members: DataFrame, features: list[str], folds: list[int]) -> tuple[Callable, dict[int, Callable]]:
    """side(fold, role), see `sided`, and of each fold what adds p, by medians and boosted trees of its training rows, to rows with the features.

    Where a fold's training rows differ in at most SHARE ways, its 120 rounds are one task's work; such folds are fitted in one job. Others are `boosted` side by side, each level of a tree a job.
    """
    met, side = sided(rows, members, features, folds)
    trees = pipeline(features, "boosting").getStages()[-1]
    given = {f: F.nanvl(F.col(f).cast("double"), F.lit(None)) for f in features}
    alike = met.groupBy("y", *[v.alias(f) for f, v in given.items()], "sides__").agg(F.count(F.lit(1)).alias("rows__"))
    train = lambda k: F.substring("sides__", folds.index(k) + 1, 1).isin("1", "3")
    parts = F.filter(F.array(*[F.when(train(k), k) for k in folds]), lambda k: k.isNotNull())
    own = alike.select("*", F.explode(parts).alias("fold")).groupBy("fold", "y", *features).agg(F.sum("rows__").cast("double").alias("rows__"))
    few = [r["fold"] for r in own.groupBy("fold").count().where(F.col("count") <= SHARE).collect()]
    middle = met.agg(*[F.percentile_approx(F.when(train(k), v), 0.5, 1000).alias(f"{f}__{k}") for k in few for f, v in given.items()]).first() if few else {}
    medians = {k: np.array([middle[f"{f}__{k}"] or 0.0 for f in features]) for k in few}
    filled = lambda k, columns: np.column_stack([np.where(np.isnan(v), m, v) for v, m in zip(columns, medians[k], strict=True)])
    sizes = trees.getMaxIter(), trees.getStepSize(), trees.getMaxDepth(), trees.getMaxBins()

    def fit(table: pa.Table) -> pa.Table:
        k = table.column("fold")[0].as_py()
        x, y, n = filled(k, [table.column(f).to_numpy() for f in features]), table.column("y").to_numpy(), table.column("rows__").to_numpy()
        rows, place = np.unique(np.column_stack([x, y]), axis=0, return_inverse=True)
        found = boosting.fit(rows[:, :-1], rows[:, -1], np.bincount(place.ravel(), n), *sizes)
        return pa.table({"fold": pa.array([k], pa.int32()), **{c: pa.array([getattr(found, c).ravel().tolist()]) for c in ("feature", "cut", "value")}})

    def scorer(k: int, found: boosting.Trees) -> Callable:
        said = F.pandas_udf(lambda *columns: pd.Series(found.probabilities(filled(k, columns))), "double")
        return lambda df: df.withColumn("p", said(*given.values()))

    shape = (sizes[0], -1)
    fits = own.where(F.col("fold").isin(few)).groupBy("fold").applyInArrow(fit, "fold int, feature array<long>, cut array<double>, value array<double>").collect() if few else []
    scores = {r["fold"]: scorer(r["fold"], boosting.Trees(*[np.reshape(r[c], shape) for c in ("feature", "cut", "value")])) for r in fits}
    many = [k for k in folds if k not in scores]
    for k, model in zip(many, of_each(lambda k: boosted(side(k, "train"), features), many), strict=True):
        scores[k] = lambda df, m=model: m.transform(df).withColumn("p", vector_to_array("probability")[1])
    return side, scores


def splits_of(n: int) -> list[tuple[int, int]]:
    """Up to three inner splits by time of n training rows: how many rows a model is fitted to, and where its held-out rows end; none if there would be fewer than two."""
    count = min(3, max(0, n // 20 - 1))
    if count < 2:
        return []
    size = n // (count + 1)
    starts = [n - (count - k) * size for k in range(count)]
    return [(a, a + size) for a in starts]


def placed(rows: DataFrame, members: DataFrame, features: list[str], folds: list[int], at: str) -> DataFrame:
    """id, y, features (missing ones as the fold-blind median), test (fold), and for each fold place_<fold>: a training row's place in time, else null."""
    trains = [f"__train_{k}" for k in folds]
    roles = members.groupBy("id").agg(*[F.coalesce(F.max((F.col("role") == "train") & (F.col("fold") == k)), F.lit(False)).alias(c) for k, c in zip(folds, trains, strict=True)], F.max(F.when(F.col("role") == "test", F.col("fold"))).alias("test"))
    wide = checkpointed(rows.join(roles, "id").select("id", F.col(at).alias("__at"), F.col("y").cast("double").alias("y"), *[F.col(f).cast("double").alias(f) for f in features], "test", *trains))
    medians = wide.agg(*[F.percentile(f, F.lit(0.5)).alias(f) for f in features]).first()
    wide = wide.select("id", "__at", "y", *[F.coalesce(f, F.lit(medians[f] or 0.0)).alias(f) for f in features], "test", *trains)
    inside = {k: F.col(c) for k, c in zip(folds, trains, strict=True)}
    run = stats.running(wide, F.struct("__at", "id"), **{f"place_{k}": inside[k].cast("long") for k in folds})
    return run.select("id", "y", *features, "test", *[F.when(inside[k], F.col(f"place_{k}")).alias(f"place_{k}") for k in folds])


class Logits:
    """Logistic regressions of all folds, inner splits and penalties, fitted together; and what they say.

    Fits see a row by label, features and, in each fold, between which splits it lies; rows alike in these are one with their number as its weight.
    """

    def __init__(self, table: DataFrame, features: list[str], folds: list[int]):
        """table: see `placed`; a checkpoint."""
        self.table, self.features, self.folds = table, features, folds
        sizes = table.agg(*[F.count(f"place_{k}").alias(f"n_{k}") for k in folds]).first()
        self.splits = {k: splits_of(sizes[f"n_{k}"]) for k in folds}
        #: fold, split (-1: all training rows), penalty
        self.of = [(k, split, c) for k in folds for split in range(-1, len(self.splits[k])) for c in PENALTIES]
        #: __part_<fold>: how many of the fold's splits a training row's place has reached, so split s is fitted to parts up to s and holds part s + 1 out; -1: no training row
        parts = [F.when(F.col(f"place_{k}").isNull(), -1).otherwise(sum([(F.col(f"place_{k}") >= a).cast("int") for a, _ in self.splits[k]], F.lit(0))).alias(f"__part_{k}") for k in folds]
        alike = ["y", *features, *[f"__part_{k}" for k in folds]]
        self.alike = checkpointed(table.select("y", *features, *parts).groupBy(*alike).agg(F.count(F.lit(1)).alias("__rows")))
        of = self.of

        def weigh(batch: pa.RecordBatch) -> np.ndarray:
            part = {k: batch.column(f"__part_{k}").to_numpy() for k in folds}
            return np.stack([(part[k] >= 0) & ((s < 0) | (part[k] <= s)) for k, s, _ in of]) * batch.column("__rows").to_numpy().astype(np.float64)

        self.fits = newton.fit(self.alike, features, weigh, len(self.of), np.array([1 / c for *_, c in self.of]))
        self.chosen = self.tuned()
        self.full = {k: self.number(k, -1) for k in folds}

    def number(self, fold: int, split: int) -> int:
        return next(i for i, (k, s, c) in enumerate(self.of) if (k, s, c) == (fold, split, self.chosen[fold]))

    def tuned(self) -> dict[int, float]:
        """The penalty of each fold with the least mean Brier loss over its inner splits; 1 without two of them."""
        held = [i for i, (_, s, _) in enumerate(self.of) if s >= 0 and self.fits.usable[i]]
        fits, features, of = self.fits, self.features, self.of

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            loss, n = np.zeros(len(of)), np.zeros(len(of))
            for batch in batches:
                rows = batch.column("__rows").to_numpy()
                error = (fits.probabilities(newton.matrix(batch, features)) - batch.column("y").to_numpy(zero_copy_only=False)[:, None]) ** 2 * rows[:, None]
                for i in held:
                    mine = batch.column(f"__part_{of[i][0]}").to_numpy() == of[i][1] + 1
                    loss[i] += error[mine, i].sum()
                    n[i] += rows[mine].sum()
            yield pa.RecordBatch.from_arrays([pa.array(range(len(of)), pa.int32()), pa.array(loss), pa.array(n)], names=["fit", "loss", "n"])

        sums = {r["fit"]: r["loss"] / r["n"] for r in self.alike.mapInArrow(run, "fit int, loss double, n double").groupBy("fit").agg(F.sum("loss").alias("loss"), F.sum("n").alias("n")).collect() if r["n"]}
        best = {}
        for k in self.folds:
            means = {c: np.mean([sums[i] for i in held if of[i][0] == k and of[i][2] == c]) for c in PENALTIES if any(of[i][0] == k and of[i][2] == c for i in held)}
            best[k] = min(means, key=means.get) if means else 1.0
        return best

    def told(self, inner: bool = True) -> DataFrame:
        """fold, split, id, y, p, z (log-odds), role: test rows by the fold's model (split -1) and, if `inner`, its splits' models, and each split's held-out rows by that split's model."""
        fits, features = self.fits, self.features
        whole, parts = self.full, {(k, s): self.number(k, s) for k in self.folds for s in range(len(self.splits[k]) if inner else 0)}
        parts = {ks: i for ks, i in parts.items() if fits.usable[i]}
        spans = {ks: self.splits[ks[0]][ks[1]] for ks in parts}
        kind = self.table.schema["id"].dataType.simpleString()
        schema = f"fold int, split int, id {kind}, y double, p double, z double, role string"
        asked = [*(((k, -1), i) for k, i in whole.items()), *parts.items()]
        slope, intercept = (c[[i for _, i in asked]] for c in (fits.slope, fits.intercept))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x, y = newton.matrix(batch, features), batch.column("y").to_numpy(zero_copy_only=False)
                z = x @ slope.T + intercept
                test = batch.column("test").fill_null(-1).to_numpy(zero_copy_only=False)
                for i, ((k, s), _) in enumerate(asked):
                    sets = [("test", test == k)]
                    if s >= 0:
                        place = batch.column(f"place_{k}").fill_null(-1).to_numpy(zero_copy_only=False)
                        sets.append(("held", (place >= spans[k, s][0]) & (place < spans[k, s][1])))
                    for role, mine in sets:
                        m = int(mine.sum())
                        columns = [pa.array([k] * m, pa.int32()), pa.array([s] * m, pa.int32()), batch.column("id").filter(pa.array(mine)), pa.array(y[mine]), pa.array(newton.sigmoid(z[mine, i])), pa.array(z[mine, i]), pa.array([role] * m, pa.string())]
                        yield pa.RecordBatch.from_arrays(columns, names=["fold", "split", "id", "y", "p", "z", "role"])

        return self.table.mapInArrow(run, schema)


def platt(held: DataFrame, keys: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Slope and intercept of log-odds for each (fold, split): a logistic fit to targets that are drawn in by the classes' sizes; all of them at once."""
    counts = held.groupBy("fold", "split").agg(F.sum("y").alias("pos"), F.sum(1 - F.col("y")).alias("neg"))
    target = F.when(F.col("y") == 1, (F.col("pos") + 1) / (F.col("pos") + 2)).otherwise(1 / (F.col("neg") + 2))
    rows = checkpointed(held.join(F.broadcast(counts), ["fold", "split"]).select("fold", "split", "z", target.alias("y")))

    def weigh(batch: pa.RecordBatch) -> np.ndarray:
        fold, split = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("fold", "split"))
        return np.stack([(fold == k) & (split == s) for k, s in keys]).astype(np.float64)

    found = newton.fit(rows, ["z"], weigh, len(keys), 1e-9)
    return found.slope[:, 0], found.intercept


def steps(held: DataFrame) -> tuple[list[float], list[float]]:
    """Scores and calibrated values of an isotonic fit; between them it is linear."""
    model = IsotonicRegression(featuresCol="p", labelCol="y", predictionCol="calibrated").fit(held.select("p", "y"))
    return list(model.boundaries), list(model.predictions)


def logistic_frame(rows: DataFrame, members: DataFrame, features: list[str], folds: list[int], at: str = "at") -> DataFrame:
    """fold, id, y and what was said of each test row out of fold: baseline (the training rate), logistic, platt, isotonic.

    Penalties are tuned on inner splits by time. A calibrator is fitted to the held-out rows of an
    inner split, scored by that split's model, and applied to that model's score of the test row;
    the splits' answers are averaged. Without inner splits both calibrated columns are the
    logistic one. Every fit of a kind is one of many solved together, but for the isotonic ones.
    """
    table = checkpointed(placed(rows, members, features, folds, at))
    logits = Logits(table, features, folds)
    told = checkpointed(logits.told())
    rate = {k: float(logits.fits.positive[i] / max(logits.fits.n[i], 1)) for k, i in logits.full.items()}
    keys = [tuple(r) for r in told.where("role = 'held'").groupBy("fold", "split").agg(F.count_distinct("y").alias("classes")).where("classes = 2").select("fold", "split").orderBy("fold", "split").collect()]
    spark = rows.sparkSession
    out = told.where("split = -1").select("fold", "id", F.col("y").cast("int").alias("y"), F.col("p").alias("logistic"))
    if keys:
        held = told.where("role = 'held'")
        a, b = platt(held, keys)
        curves = {ks: steps(held.where((F.col("fold") == ks[0]) & (F.col("split") == ks[1]))) for ks in keys}
        place = {ks: i for i, ks in enumerate(keys)}

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                p, z = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("p", "z"))
                of = list(zip(batch.column("fold").to_pylist(), batch.column("split").to_pylist(), strict=True))
                number = np.array([place.get(ks, -1) for ks in of], np.int64)
                first, second = np.full(len(p), np.nan), np.full(len(p), np.nan)
                for ks, i in place.items():
                    mine = number == i
                    first[mine] = newton.sigmoid(a[i] * z[mine] + b[i])
                    second[mine] = np.interp(p[mine], *curves[ks])
                yield pa.RecordBatch.from_arrays([batch.column("fold"), batch.column("id"), pa.array(first, from_pandas=True), pa.array(second, from_pandas=True)], names=["fold", "id", "platt", "isotonic"])

        kind = table.schema["id"].dataType.simpleString()
        mean = told.where("role = 'test' AND split >= 0").mapInArrow(run, f"fold int, id {kind}, platt double, isotonic double").groupBy("fold", "id").agg(F.avg("platt").alias("platt"), F.avg("isotonic").alias("isotonic"))
        out = out.join(mean, ["fold", "id"], "left")
    else:
        out = out.withColumns({"platt": F.lit(None).cast("double"), "isotonic": F.lit(None).cast("double")})
    rates = spark.createDataFrame(list(rate.items()), "fold int, baseline double")
    return out.join(F.broadcast(rates), "fold").select("fold", "id", "y", "baseline", "logistic", F.coalesce("platt", "logistic").alias("platt"), F.coalesce("isotonic", "logistic").alias("isotonic"))


def out_of_fold(rows: DataFrame, members: DataFrame, features: list[str], folds: list[int], kind: str = "logistic", at: str = "at") -> DataFrame:
    """fold, id, y, p of each test row, predicted by a model that saw only its fold's training rows; the penalty of logistic regression is tuned on those too."""
    if kind == "logistic":
        told = Logits(checkpointed(placed(rows, members, features, folds, at)), features, folds).told(inner=False)
        return told.select("fold", "id", F.col("y").cast("int").alias("y"), "p")
    side, scores = boosters(rows, members, features, folds)
    out = None
    for fold in folds:
        part = scores[fold](side(fold, "test")).select(F.lit(fold).alias("fold"), "id", "y", "p")
        out = part if out is None else out.unionByName(part)
    return out


def permutation_importance(score: Callable[[DataFrame], DataFrame], test: DataFrame, features: list[str], repeats: int = 10, seed: int = 1) -> DataFrame:
    """feature, importance: by how much the Brier loss grows, on average over `repeats`, where a feature's values are dealt to other rows.

    score: adds p to rows with the features; test: id, y, features. Rows are numbered in a seeded
    random order, by ranges of it; a repeat's permutation of n numbers is r -> (a r + b) mod n, so
    each row gets its value from one join, and all repeats and features are scored in one plan.
    """
    order = F.struct(F.xxhash64(F.lit(seed), F.col("id")).alias("h"), "id")
    rows = checkpointed(stats.running(test.select("id", "y", *features), order, row__=F.lit(1)))
    n = rows.count()
    if n < 2:
        return rows.sparkSession.createDataFrame([(f, None) for f in features], "feature string, importance double")
    rng = np.random.default_rng(seed)
    maps = []
    while len(maps) < repeats:
        a = int(rng.integers(1, min(n, 2**31)))
        if math.gcd(a, n) == 1:
            maps.append((len(maps), a, int(rng.integers(0, min(n, 2**31)))))
    dealt = F.broadcast(rows.sparkSession.createDataFrame(maps, "rep__ int, times__ long, plus__ long"))
    takers = rows.join(dealt).select("*", F.pmod(F.col("times__").cast("decimal(20,0)") * F.col("row__") + F.col("plus__"), F.lit(n)).cast("long").alias("from__"))
    donors = rows.select(F.col("row__").alias("from__"), *[F.col(f).alias(f"{f}__other") for f in features])
    many = takers.join(donors, "from__").select("id", "y", F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), *[F.col(f"{g}__other" if g == f else g).alias(g) for g in features]) for f in features])).alias("s")).select("id", "y", "s.*")
    error = F.avg((F.col("p") - F.col("y")) * (F.col("p") - F.col("y")))
    base = F.broadcast(score(rows.select("id", "y", *features)).agg(error.alias("base")))
    return score(many).groupBy("feature").agg(error.alias("e")).join(base).select("feature", (F.col("e") - F.col("base")).alias("importance"))


def boosting_importance(rows: DataFrame, members: DataFrame, features: list[str], folds: list[int], repeats: int = 10, seed: int = 1) -> DataFrame:
    """feature, importance of the boosted trees, averaged over the folds' test rows."""
    side, scores = boosters(rows, members, features, folds)
    parts = None
    for fold in folds:
        part = permutation_importance(scores[fold], side(fold, "test"), features, repeats, seed)
        parts = part if parts is None else parts.unionByName(part)
    return parts.groupBy("feature").agg(F.avg("importance").alias("importance"))


def isotonic(scored: DataFrame) -> DataFrame:
    """`scored` (id, y, p) with a monotone recalibration of p."""
    model = IsotonicRegression(featuresCol="p", labelCol="y", predictionCol="calibrated").fit(scored.select(F.col("p"), F.col("y").cast("double")))
    return model.transform(scored)
