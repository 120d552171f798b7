"""Intervals of metrics and coefficients against brute force over copies of days."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from driftline.operators import intervals, models
from driftline.operators.resample import draws

REPS, SEED = 60, 5


def picked(days):
    return [draws(SEED, np.array(rep), np.arange(days)) % days for rep in range(REPS)]


def metrics(y, p):
    y, p = np.asarray(y, float), np.asarray(p, float)
    q = np.clip(p, 1e-8, 1 - 1e-8)
    pos, neg = p[y == 1], p[y == 0]
    auc = np.mean((pos[:, None] > neg[None, :]) + (pos[:, None] == neg[None, :]) / 2) if len(pos) and len(neg) else np.nan
    ap = sum((y[p == s].sum()) * y[p >= s].sum() / (p >= s).sum() for s in np.unique(p)) / y.sum() if y.sum() else np.nan
    return {"log_loss": np.mean(-np.where(y == 1, np.log(q), np.log(1 - q))), "brier": np.mean((p - y) ** 2), "roc_auc": auc, "pr_auc": ap}


@pytest.fixture(scope="module")
def scored():
    rng = np.random.default_rng(1)
    n = 700
    x = rng.normal(size=(n, 2))
    y = (rng.random(n) < 1 / (1 + np.exp(-(x[:, 0] - 0.5 * x[:, 1])))).astype(int)
    frame = pd.DataFrame({"day": [f"d{i:02}" for i in rng.integers(0, 12, n)], "y": y, "a": np.round(1 / (1 + np.exp(-x[:, 0])), 2), "b": np.round(rng.random(n), 1), "x1": x[:, 0] * 3 + 10, "x2": x[:, 1]})
    frame.loc[frame["day"] == "d03", "y"] = 0  # a day of one class
    return frame


def resampled(frame):
    blocks = [b for _, b in frame.groupby("day")]
    return [pd.concat([blocks[i] for i in p]) for p in picked(len(blocks))]


def test_metric_intervals(spark, scored, monkeypatch):
    monkeypatch.setattr(intervals, "CELLS", 61 * 7)  # several runs of scores a task
    rows = spark.createDataFrame(scored[["y", "a", "b", "day"]]).select("y", "day", F.explode(F.create_map(F.lit("a"), "a", F.lit("b"), "b")).alias("model", "p"))
    rows = rows.unionByName(spark.createDataFrame([(2, "d01", "a", 0.5), (None, "d01", "a", 0.5), (1, None, "a", 0.5), (1, "d01", "a", None), (0, "d02", "b", float("nan"))], rows.schema))
    got = {(r["model"], r["metric"]): r for r in intervals.metric_intervals(rows.repartition(3), REPS, SEED).collect()}
    for model in ("a", "b"):
        whole, again = metrics(scored["y"], scored[model]), pd.DataFrame([metrics(s["y"], s[model]) for s in resampled(scored)])
        for metric in intervals.METRICS:
            r = got[model, metric]
            assert r["estimate"] == pytest.approx(whole[metric], abs=1e-12)
            assert (r["low"], r["high"]) == pytest.approx(tuple(np.nanquantile(again[metric], [0.025, 0.975])), abs=1e-12)
    assert len(got) == 8 and intervals.metric_intervals(rows.limit(0), REPS, SEED).count() == 0


def test_paired_differences(spark, scored):
    rows = spark.createDataFrame(scored[["y", "a", "b", "day"]])
    got = {r["metric"]: r for r in intervals.paired_differences(rows, "a", "b", REPS, SEED).collect()}
    again = pd.DataFrame([{m: x - z[m] for m, x in metrics(s["y"], s["a"]).items()} for s in resampled(scored) for z in [metrics(s["y"], s["b"])]])
    for metric in intervals.METRICS:
        assert got[metric]["difference"] == pytest.approx(metrics(scored["y"], scored["a"])[metric] - metrics(scored["y"], scored["b"])[metric], abs=1e-12)
        assert (got[metric]["low"], got[metric]["high"]) == pytest.approx(tuple(np.nanquantile(again[metric], [0.025, 0.975])), abs=1e-12)
    few = intervals.paired_differences(rows.where("day < 'd02'"), "a", "b", REPS, SEED).collect()
    assert all(r["low"] is None and r["days"] == 2 for r in few)


def ridge_logistic(frame, features, c):
    x = frame[features].to_numpy(float)
    x = (x - x.mean(0)) / x.std(0)
    one, y, b = np.c_[x, np.ones(len(x))], frame["y"].to_numpy(float), np.zeros(len(features) + 1)
    ridge = np.append(np.full(len(features), 1 / c), 1e-9)
    for _ in range(50):
        p = 1 / (1 + np.exp(-one @ b))
        b -= np.linalg.solve((one * (p * (1 - p))[:, None]).T @ one + np.diag(ridge), one.T @ (p - y) + ridge * b)
    return b[:-1]


def test_coefficients(spark, scored):
    features = ["x1", "x2"]
    frame = scored.copy()
    frame.loc[::50, "x2"] = np.nan
    filled = frame.assign(x2=frame["x2"].fillna(frame["x2"].median()))
    rows = spark.createDataFrame(frame[["y", "day", *features]].astype(object).where(frame[["y", "day", *features]].notna(), None), "y long, day string, x1 double, x2 double")
    got = {r["feature"]: r for r in intervals.coefficients(rows.repartition(3), features, 0.5, REPS, SEED).collect()}
    again = np.array([ridge_logistic(s, features, 0.5) for s in resampled(filled)])
    for j, f in enumerate(features):
        assert got[f]["coefficient"] == pytest.approx(ridge_logistic(filled, features, 0.5)[j], abs=1e-7)
        assert (got[f]["low"], got[f]["high"]) == pytest.approx(tuple(np.quantile(again[:, j], [0.025, 0.975])), abs=1e-7)
    assert intervals.coefficients(rows.limit(0), features).count() == 0


# ---- models

def timed(spark, n=600, seed=3):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 2))
    y = (rng.random(n) < 1 / (1 + np.exp(-(1.5 * x[:, 0] + 0.3)))).astype(int)
    frame = pd.DataFrame({"id": range(n), "at": rng.permutation(n), "y": y, "a": x[:, 0] * 4 - 2, "b": x[:, 1]})
    fold = np.minimum(frame["at"] * 4 // n, 3)
    members = [(int(i), k, "test" if f == k else "train") for k in (1, 2, 3) for i, f in zip(frame["id"], fold, strict=True) if f <= k]
    return frame, spark.createDataFrame(frame), spark.createDataFrame(members, "id long, fold int, role string")


def pool_adjacent(p, y):
    """Distinct scores and their isotonic values."""
    found = [[s, float(y[p == s].sum()), int((p == s).sum())] for s in np.unique(p)]
    pools = []
    for s, total, n in found:
        pools.append([[s], total, n])
        while len(pools) > 1 and pools[-2][1] / pools[-2][2] >= pools[-1][1] / pools[-1][2]:
            ss, t, m = pools.pop()
            pools[-1] = [pools[-1][0] + ss, pools[-1][1] + t, pools[-1][2] + m]
    return np.array([s for ss, *_ in pools for s in ss]), np.array([t / m for ss, t, m in pools for _ in ss])


def fitted(train, c, features=("a", "b")):
    x = train[list(features)].to_numpy(float)
    mean, std = x.mean(0), x.std(0)
    b = ridge_full((x - mean) / std, train["y"].to_numpy(float), c)
    return lambda f: b[-1] + (f[list(features)].to_numpy(float) - mean) / std @ b[:-1]


def ridge_full(x, y, c):
    one, b = np.c_[x, np.ones(len(x))], np.zeros(x.shape[1] + 1)
    ridge = np.append(np.full(x.shape[1], 1 / c), 1e-9)
    for _ in range(100):
        p = 1 / (1 + np.exp(-one @ b))
        b -= np.linalg.solve((one * (p * (1 - p))[:, None]).T @ one + np.diag(ridge), one.T @ (p - y) + ridge * b)
    return b


def test_calibrated_frame(spark):
    frame, rows, members = timed(spark)
    got = models.logistic_frame(rows, members, ["a", "b"], [1, 2, 3]).toPandas().set_index("id")
    sig = lambda z: 1 / (1 + np.exp(-z))
    fold = np.minimum(frame["at"] * 4 // len(frame), 3)
    for k in (1, 2, 3):
        train, test = frame[fold < k].sort_values("at"), frame[fold == k]
        splits = models.splits_of(len(train))
        assert len(splits) == 3
        loss = {c: np.mean([np.mean((sig(fitted(train[:a], c)(train[a:b])) - train["y"][a:b]) ** 2) for a, b in splits]) for c in models.PENALTIES}
        c = min(loss, key=loss.get)
        own = got.loc[test["id"]]
        assert own["fold"].eq(k).all() and own["baseline"].to_numpy() == pytest.approx(train["y"].mean())
        assert own["logistic"].to_numpy() == pytest.approx(sig(fitted(train, c)(test)), abs=1e-6)
        platt, isotonic = [], []
        for a, b in splits:
            score = fitted(train[:a], c)
            z, y = score(train[a:b]), train["y"][a:b].to_numpy()
            soft = np.where(y == 1, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))
            w = ridge_full(((z - z.mean()) / z.std())[:, None], soft, 1e9)
            platt.append(sig(w[-1] + w[0] * (score(test) - z.mean()) / z.std()))
            isotonic.append(np.interp(sig(score(test)), *pool_adjacent(sig(z), y)))
        assert own["platt"].to_numpy() == pytest.approx(np.mean(platt, 0), abs=1e-5)
        assert own["isotonic"].to_numpy() == pytest.approx(np.mean(isotonic, 0), abs=1e-5)
    assert len(got) == (fold > 0).sum()


def test_frame_without_inner_splits_is_not_calibrated(spark):
    frame, rows, members = timed(spark, 60)
    got = models.logistic_frame(rows, members, ["a", "b"], [1]).toPandas()
    assert len(got) == 15 and (got["platt"] == got["logistic"]).all() and (got["isotonic"] == got["logistic"]).all()


def test_permutation_importance(spark):
    frame, rows, _ = timed(spark)
    score = lambda df: df.withColumn("p", 1 / (1 + F.exp(-(F.col("a") * 0.4 + 0.8))))
    got = {r["feature"]: r["importance"] for r in models.permutation_importance(score, rows, ["a", "b"], repeats=10).collect()}
    p = lambda a: 1 / (1 + np.exp(-(a * 0.4 + 0.8)))
    a, y = frame["a"].to_numpy(), frame["y"].to_numpy()
    rng = np.random.default_rng(0)
    want = np.mean([np.mean((p(rng.permutation(a)) - y) ** 2) for _ in range(200)]) - np.mean((p(a) - y) ** 2)
    assert got["b"] == pytest.approx(0, abs=1e-12) and got["a"] == pytest.approx(want, rel=0.1)
    assert models.permutation_importance(score, rows.limit(0), ["a", "b"]).where("importance IS NOT NULL").count() == 0


def test_permutations_deal_every_value_once(spark):
    """A score that is the value itself shows, for each repeat, the same multiset of values."""
    rows = spark.createDataFrame([(i, 0, float(i)) for i in range(101)], "id long, y int, a double")
    seen = []
    models.permutation_importance(lambda df: seen.append(df) or df.withColumn("p", F.col("a")), rows, ["a"], repeats=4)
    many = next(df for df in seen if "feature" in df.columns)
    assert sorted(r["a"] for r in many.collect()) == sorted(float(i) for i in range(101) for _ in range(4))


def test_coefficients_see_rows_that_are_alike_once(spark, monkeypatch):
    """Ten copies of a table are no more rows to Newton's steps, and a step's arrays stay below 2 MB each."""
    from driftline.operators import newton

    seen, fit = [], newton.fit
    monkeypatch.setattr(newton, "fit", lambda rows, *a, **k: seen.append(rows.count()) or fit(rows, *a, **k))
    data = [(i % 7, i % 3, int(i * i % 5 < 2)) for i in range(90)]
    for own in (data, data * 10):
        intervals.coefficients(spark.createDataFrame([(d, float(a), y) for d, a, y in own], "day int, a double, y int"), ["a"], reps=5)
    assert seen == [len(set(data))] * 2 and newton.CELLS * 8 <= 2_000_000
