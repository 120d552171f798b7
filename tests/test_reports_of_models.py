"""Quantile bins against pandas, the family-wise p against numpy, flow features by hand."""

import math

import numpy as np
import pandas as pd
import pytest

from driftline.operators import boosting, flow, models, resample, stats


def bins_of(y, p, most=10):
    data = pd.DataFrame({"y": y, "p": p}).dropna()
    q = min(most, max(2, len(data) // 25), data.p.nunique())
    data["bin"] = pd.qcut(data.p, q, duplicates="drop", labels=False) if q > 1 else 0
    return [(int(b), len(g), round(g.p.mean(), 9), round(g.y.mean(), 9)) for b, g in data.groupby("bin")]


@pytest.mark.parametrize("kind", ["spread", "ties", "two", "one", "few", "empty"])
def test_quantile_bins(spark, kind):
    rng = np.random.default_rng(1)
    p = {"spread": rng.random(700), "ties": np.round(rng.random(900) ** 4, 1), "two": rng.integers(0, 2, 300) / 4 + 0.25, "one": np.full(60, 0.3), "few": rng.random(7), "empty": np.array([])}[kind]
    y = (rng.random(len(p)) < p).astype(int)
    rows = [(int(a), float(b)) for a, b in zip(y, p, strict=True)]
    extra = [(None, 0.5), (1, None), (1, math.nan)]
    got = stats.quantile_reliability(spark.createDataFrame(rows + extra, "y int, p double").repartition(5), "y", "p")
    assert [(r["bin"], r["n"], round(r["mean_score"], 9), round(r["mean_outcome"], 9)) for r in got.orderBy("bin").collect()] == bins_of(y, p)


def test_family_wise_p(spark):
    rng = np.random.default_rng(2)
    days = [(k, i, int(v)) for k, shift in (("a", 0), ("b", -60), ("c", -20)) for i, v in enumerate(rng.normal(shift, 100, 40)) if not (k == "c" and i % 3)]
    table = spark.createDataFrame(days, "k string, i long, v long").repartition(4)
    (row,) = resample.sign_flip_family(table, "k", "i", "v", 400, 9).collect()
    frame = pd.DataFrame(days, columns=["k", "i", "v"])
    seen = frame.groupby("k").v.mean()
    m = resample.flipped_means(table, ["k"], "i", "v", 400, 9).toPandas()
    # the signs of a day are alike for all keys, and half of them each way
    wide = m.pivot(index="rep", columns="k", values="m")
    assert len(wide) == 400 and abs(wide.mean()).max() < 6
    assert (row["best"], row["mean"]) == (seen.idxmin(), pytest.approx(seen.min())) and row["p"] == pytest.approx(((wide.min(axis=1) <= seen.min() + 1e-9).sum() + 1) / 401)
    single = {r["k"]: r["p"] for r in resample.sign_flip(table, ["k"], "i", "v", 400, 9).collect()}
    assert row["p"] >= single[row["best"]]
    assert resample.sign_flip_family(table.limit(0), "k", "i", "v", 10, 9).collect() == []


def test_flow_features(spark):
    minute = 60_000
    rows = [
        ("a", 0, 1, 10, 8, 4, 100.0, 50.0), ("a", 0, 2, 20, 9, 3, 200.0, 50.0), ("a", 5 * minute, 3, 26, 8, 2, 300.0, 30.0), ("a", 5 * minute - 1, 4, 1, 8, 0, 0.0, 30.0), ("a", 70 * minute, 5, None, 8, 2, math.nan, 30.0), ("a", 80 * minute, 6, 7, 8, 2, 400.0, math.inf),
        ("b", 5 * minute, 7, 1, 1, 1, 1.0, 1.0), ("a", None, 8, 9, 9, 9, 9.0, 9.0), (None, 0, 9, 1, 1, 1, 2.0, 1.0), (None, 15 * minute, 10, 3, 3, 1, 3.0, 1.0),
    ]
    t = spark.createDataFrame(rows, "k string, at long, id long, buyers long, buys long, sells long, liquidity double, volume double").repartition(3)
    names = ["volume_to_liquidity", "buyer_acceleration", "count_ratio_trend", "liquidity_change_15m", "liquidity_change_30m", "liquidity_change_60m"]
    near = lambda *v: tuple(None if x is None else pytest.approx(x) for x in v)
    got = {r["id"]: tuple(r[n] for n in names) for r in flow.flow_features(t, ["k"]).collect()}
    assert got == {
        1: near(0.5, None, None, None, None, None), 2: near(0.25, None, None, None, None, None), 3: near(0.1, 6, 1.0, None, None, None), 4: near(None, None, None, None, None, None), 5: near(None, None, 0.0, None, None, None),
        6: near(None, None, 0.0, 100 * 4 / 3 - 100, 100 * 4 / 3 - 100, 100 * 4 / 3 - 100), 7: near(1.0, None, None, None, None, None), 8: near(1.0, None, None, None, None, None), 9: near(0.5, None, None, None, None, None), 10: near(1 / 3, 2, 2.0, 50.0, None, None),
    }


def test_boosted_trees_see_equal_rows_as_one_with_a_weight(spark, monkeypatch):
    whole, seen = models.pipeline, []

    def short(*args):
        p = whole(*args)
        trees = p.getStages()[-1].setMaxIter(4)
        fit = trees.fit
        trees.fit = lambda df: seen.append(df.count()) or fit(df)
        return p

    monkeypatch.setattr(models, "pipeline", short)
    rows = spark.range(600).selectExpr("id", "double(id % 5) AS a", "CASE WHEN id % 7 < 6 THEN double(id % 7) END AS b", "int(id * id % 11 < 4 + id % 5) AS y")
    said = lambda model: [r["probability"][1] for r in model.transform(rows).orderBy("id").collect()]
    got = said(models.boosted(rows, ["a", "b"]))
    assert seen[0] <= 2 * 5 * 6
    assert got == pytest.approx(said(whole(["a", "b"], "boosting").setStages([*whole(["a", "b"], "boosting").getStages()[:-1], whole(["a", "b"], "boosting").getStages()[-1].setMaxIter(4)]).fit(rows)), abs=1e-9)


def folded(spark):
    """Rows with missing values and more different ones than bins, and two folds; one row is tested in both."""
    rows = spark.range(900).selectExpr("id", "double(id * 37 % 101) AS a", "CASE WHEN id % 7 < 5 THEN double(id % 7) WHEN id % 7 = 5 THEN double('NaN') END AS b", "int(id * 37 % 101 + id * id % 60 > 70) AS y")
    side = "SELECT id, 1 AS fold, CASE WHEN id < 400 THEN 'train' ELSE 'test' END AS role FROM {r} WHERE id < 601 UNION ALL SELECT id, 2, CASE WHEN id < 590 THEN 'train' ELSE 'test' END FROM {r} WHERE id < 590 OR id >= 600"
    return rows, spark.sql(side, r=rows)


def test_boosted_folds_of_few_different_rows_are_fitted_in_one_job(spark):
    rows, members = folded(spark)
    spark.sparkContext.setJobGroup("boosted folds", "")
    got = models.out_of_fold(rows, members, ["a", "b"], [1, 2], "boosting").collect()
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("boosted folds")) < 40
    assert sorted((r["fold"], r["id"]) for r in got) == [(1, i) for i in range(400, 601)] + [(2, i) for i in range(600, 900)]


def test_boosted_folds_are_those_of_mllib_in_either_way(spark, monkeypatch):
    whole, sizes = models.pipeline, []

    def short(*args):
        p = whole(*args)
        trees = p.getStages()[-1].setMaxIter(6)
        fit = trees.fit
        trees.fit = lambda df: sizes.append(df.rdd.getNumPartitions()) or fit(df)
        return p

    monkeypatch.setattr(models, "pipeline", short)
    rows, members = folded(spark)
    said = lambda: {(r["fold"], r["id"]): r["p"] for r in models.out_of_fold(rows, members, ["a", "b"], [1, 2], "boosting").collect()}
    few = said()
    assert sizes == []
    one = {}
    for fold in (1, 2):
        own = members.where(f"fold = {fold}")
        model = models.boosted(rows.join(own.where("role = 'train'"), "id"), ["a", "b"])
        one |= {(fold, r["id"]): r["probability"][1] for r in model.transform(rows.join(own.where("role = 'test'"), "id")).collect()}
    assert few == pytest.approx(one, abs=1e-9) and sizes == [1, 1] and len(set(few.values())) > 10
    monkeypatch.setattr(models, "SHARE", 50)
    assert said() == pytest.approx(one, abs=1e-9) and len(sizes) == 4 and min(sizes[2:]) > 1


@pytest.mark.parametrize("y", [0, 1])
def test_boosted_trees_of_one_class_or_one_value_are_leaves(y):
    found = boosting.fit(np.array([[1.0, 5.0], [1.0, 5.0], [1.0, 6.0]]), np.full(3, float(y)), np.array([2.0, 1.0, 4.0]), 5, 0.04, 2, 32)
    assert (found.feature == -1).all() and np.isfinite(found.value).all()
    assert ((found.probabilities(np.array([[0.0, 9.0]])) > 0.5) == y).all()
