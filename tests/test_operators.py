"""Hand-computed values and metamorphic tests."""

import time
from collections import defaultdict

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from driftline.operators import costs, flow, joins, ledger, models, resample, simulate, stats, validation
from driftline.operators import timeseries as ts
from driftline.plans import catalogue, research
from driftline.plans.views import fills
from driftline.session import checkpointed
from driftline.sources import sinks, tables
from driftline.streaming import streams


BAR = 300_000


def simulated(spark, bars, structure, stop, hours=24, target=0.0, trail=0.0, atr=None, support=None):
    rows = [(1, i, i * BAR, *map(float, x), 100.0, atr, support) for i, x in enumerate(bars)]
    paths = spark.createDataFrame(rows, "id long, i long, at long, open double, high double, low double, close double, entry double, atr double, support double")
    return simulate.simulate(paths, simulate.Grid((structure,), (stop,), (hours,), (float(target),), (float(trail),)), BAR).collect()


def near(row, gross, reason, **more):
    return row["gross"] == pytest.approx(gross) and row["reason"] == reason and all(row[k] == pytest.approx(v) for k, v in more.items())


def test_simulator_by_hand(spark):
    one = lambda *a, **k: simulated(spark, *a, **k)[0]
    assert near(one([(100, 120, 94, 110)], "single", "fixed5", target=10), -5, "stop", bars=1, best=1.2)
    assert near(one([(100, 106, 103, 105)], "trailing", "fixed5", target=5, atr=2.0), 4.5, "trail")
    assert near(one([(100, 150, 100, 140), (140, 160, 100, 115)], "fat", "fixed20", trail=30), 5, "trail", best=1.5, bars=2)
    assert near(one([(100, 210, 100, 200), (200, 510, 150, 500), (500, 520, 190, 200)], "ladder", "fixed20", trail=40), 228, "trail", best=5.1)
    assert near(one([(100, 111, 100, 110), (110, 125, 101, 120)], "half", "fixed5", target=10), 5, "breakeven", bars=1)
    assert near(one([(100, 111, 101, 110), (110, 125, 101, 120)], "half", "fixed5", target=10), 15, "tp2", bars=2)
    flat = [(100, 101, 99, 100)] * 24
    assert near(one(flat, "half", "fixed5", hours=2, target=10), 0, "time", bars=24, exit_at=24 * BAR) and near(one(flat[:20], "half", "fixed5", hours=2, target=10), 0, "open", bars=20)
    assert near(one([(100, 101, 80, 90), (70, 71, 60, 65)], "single", "support", target=5, support=75.0), -30, "stop", bars=2)
    assert near(one([(100, 101, 96, 98)], "single", "atr1.5", target=5, atr=2.0), -3, "stop")
    for stop, atr, support in (("support", 1.0, None), ("support", 1.0, 100.0), ("support", 1.0, -1.0), ("atr2", None, 90.0), ("atr2", 0.0, 90.0)):
        assert simulated(spark, flat, "single", stop, target=5, atr=atr, support=support) == []
    assert simulated(spark, flat, "trailing", "fixed5", target=5) == []


def test_closed_form_equals_grid(spark):
    rng = np.random.default_rng(0)
    rows = []
    for k in range(60):
        price = 100.0
        for i in range(12):
            o = price
            c = o * float(np.exp(rng.normal(0, 0.1)))
            rows.append((k, i, i, o, max(o, c) * 1.03, min(o, c) * 0.97, c, 100.0, 1.0, 90.0))
            price = c
    paths = spark.createDataFrame(rows, "id long, i long, at long, open double, high double, low double, close double, entry double, atr double, support double")
    name = {"tp": "target", "open": "time"}
    a = {r["id"]: (round(r["gross"], 9), r["reason"], r["bars"]) for r in simulate.single_target(paths, 20, 20).collect()}
    b = {r["id"]: (round(r["gross"], 9), name.get(r["reason"], r["reason"]), r["bars"]) for r in simulate.simulate(paths, simulate.Grid(("single",), ("fixed20",), (168,), (20.0,)), BAR).collect()}
    assert a == b


def test_costs(spark):
    one = spark.range(1)
    got = one.select(
        costs.modelled_bps(F.lit(50.0), F.lit(100_000.0), F.lit(100_000.0), F.lit(100.0), F.lit(5.0)).alias("m"),
        *[costs.liquidity_bucket(F.lit(x)).alias(str(x)) for x in (49_999, 50_000, 1_000_000)],
    ).first()
    assert got["m"] == pytest.approx(1230.0) and got["49999"] == "<50k" and got["50000"] == "50k-<100k" and got["1000000"] == ">=1m"


def test_statistics(spark):
    rows = spark.createDataFrame([("a", 0.0)] * 99 + [("a", 900.0)], "k string, v double")
    t = stats.tail(rows, ["k"], "v").first()
    assert t["mean"] == 9 and t["share_double"] == pytest.approx(0.01) and t["mean_below_p99"] == 0
    scored = spark.createDataFrame([(0, 0.25), (1, 0.75)], "y int, p double")
    assert stats.brier_logloss(scored, "y", "p").first()["brier"] == pytest.approx(0.0625)
    assert stats.roc_auc(scored, "y", "p").first()["auc"] == 1
    r = spark.createDataFrame([(5.0,), (5.0,), (-10.0,), (-10.0,)], "v double")
    assert r.agg(stats.breakeven("v")).first()[0] == pytest.approx(2 / 3)


def test_equity_by_hand(spark):
    """Balances and peaks go on over ranges; a null profit adds nothing, a null key is one."""
    rng = np.random.default_rng(3)
    data = [(k, int(at), None if rng.random() < 0.1 else int(rng.integers(-50, 50))) for k in ("a", None) for at in rng.permutation(300)]
    got = stats.equity(spark.createDataFrame(data, "k string, at int, v long"), ["k"], "v", ["at"])
    want = []
    for k in ("a", None):
        balance, peak = None, 0
        for _, at, v in sorted((r for r in data if r[0] == k), key=lambda r: r[1]):
            balance = balance if v is None else (balance or 0) + v
            peak = max(peak, balance or 0)
            want.append((str(k), at, balance, peak, None if balance is None else peak - balance))
    assert sorted((str(r["k"]), r["at"], r["balance"], r["peak"], r["drawdown"]) for r in got.collect()) == sorted(want)
    plan = got._jdf.queryExecution().analyzed().toString()
    assert "windowspecdefinition(k#" in plan and "__part" in plan.split("windowspecdefinition(k#", 1)[1].split(")", 1)[0]


def test_equity_of_fills_that_repeat_a_line(spark, tmp_path):
    """Two fills of one rule, day, order and line with different profits: the query and its SQL take the lesser first."""
    import duckdb

    rows = [(1, p, 1, 1, 1.0, "A", "2024-01-01 00:00:00") for p in (6, 0, 12, 18, 24, 30, 36, 42)]
    for name, data in (("a", rows), ("b", rows[::-1])):
        df = spark.createDataFrame(data, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_extendedprice double, l_returnflag string, l_shipdate string")
        df.withColumn("l_shipdate", F.col("l_shipdate").cast("timestamp_ntz")).coalesce(1).write.parquet(f"{tmp_path}/{name}/lineitem.parquet")
        got = sorted((r["balance"], r["drawdown"]) for r in catalogue.queries()["equity_drawdown"](spark, f"{tmp_path}/{name}").collect())
        duck = duckdb.connect()
        duck.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/{name}/lineitem.parquet/*.parquet'")
        assert got == sorted(duck.execute(f"SELECT balance, drawdown FROM ({catalogue.oracle_sql()['equity_drawdown']})").fetchall())
        total, want = 0, []
        profits = sorted((p * 7919 + 104729 + 31) % 4001 - 2000 for p in (r[1] for r in rows))
        for v in profits:
            total += v
            want.append(total)
        assert [b for b, _ in got] == sorted(want)


def test_trade_ids_do_not_depend_on_trailing_zeros(spark):
    t = spark.sql("SELECT 'c' AS chain, 'p' AS pool, 't' AS tx, 'u' AS trader, 'buy' AS side, cast(1000 AS decimal(20,10)) AS usd UNION ALL SELECT 'c', 'p', 't', 'u', 'buy', cast('1000.0' AS decimal(20,10))")
    assert t.select(flow.trade_id()).distinct().count() == 1


def test_folds_are_disjoint_purged_and_embargoed(spark):
    hour = 3_600_000
    rows = [(2 * g + i, f"g{g}", g * 72 * hour + i * hour, g * 72 * hour + i * hour + 24 * hour, i) for g in range(12) for i in range(2)]
    df = spark.createDataFrame(rows, "id long, grp string, at long, resolved_at long, y int")
    members, folds = validation.walk_forward(df, embargo=24 * hour)
    found = validation.violations(members, df, embargo=24 * hour).collect()
    assert len(found) == len(folds) and all(r["shared_groups"] == r["unpurged"] == r["embargoed"] == 0 and r["in_order"] for r in found)
    late = validation.violations(members, df.withColumn("resolved_at", F.lit(10**12)), embargo=10**9 * 1000).first()
    assert late["unpurged"] == late["embargoed"] == late["n_train"]
    at = {r[0]: r for r in rows}
    for r in members.collect():
        fold = next(f for f in folds if f.number == r["fold"])
        if r["role"] == "train":
            assert at[r["id"]][2] < fold.start - 24 * hour and at[r["id"]][3] < fold.start


def test_stream_state_lasts_over_batches(spark, tmp_path):
    """First prices and what is done are kept from one file of the stream to the next."""
    rows = [[(1, 1, 10.0), (2, 2, 10.0), (3, 1, 9.5)], [(4, 1, 12.0), (5, 2, 10.2)], [(6, 1, 5.0), (7, 2, 7.0)]]
    for n, part in enumerate(rows):
        frame = spark.createDataFrame([(i, u, v - 1, 1000 * i) for i, u, v in part], "event_id long, user_id long, value double, ms long")
        frame.select("event_id", "user_id", "value", F.timestamp_millis("ms").alias("ts")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(1)
    schema = spark.read.parquet(str(tmp_path / "in")).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = {(r["user_id"], r["at"], r["first_hit"]) for r in streams.replay(streams.first_hits(stream, "user_id", 0.9, 1.1)).collect()}
    assert got == {(1, 4000, "target"), (2, 7000, "stop")}


def test_neighbours_and_ranks_by_hand(spark):
    left = spark.createDataFrame([(1, "a", 10), (2, "a", 20), (3, "b", 5), (4, None, 1)], "id long, k string, at long")
    right = spark.createDataFrame([("a", 10, 1.0), ("a", 10, 0.5), ("a", 14, 2.0), ("a", 26, 3.0), ("b", 9, 4.0)], "k string, at long, v double")
    assert {r["id"]: r["v"] for r in joins.first_at_or_after(left, right, ["k"], "id", "v", 7).collect()} == {1: 0.5, 2: 3.0, 3: 4.0}
    assert {r["id"]: r["v"] for r in joins.nearest(left, right, ["k"], "id", "v", 6).collect()} == {1: 0.5, 2: 2.0, 3: 4.0}
    rng = np.random.default_rng(3)
    p, y = rng.integers(0, 50, 400) / 50, rng.integers(0, 2, 400)
    scored = spark.createDataFrame([(float(a), int(b)) for a, b in zip(p, y)], "p double, y int")
    wins = sum((a > b) + 0.5 * (a == b) for a in p[y == 1] for b in p[y == 0]) / ((y == 1).sum() * (y == 0).sum())
    assert stats.roc_auc(scored, "y", "p").first()["auc"] == pytest.approx(wins)
    assert {r["y"]: r["upper_median"] for r in stats.upper_median(scored, ["y"], "p").collect()} == {k: sorted(p[y == k])[(y == k).sum() // 2] for k in (0, 1)}


def test_ledger(spark):
    old = spark.createDataFrame([("a", 1)], "k string, at int")
    new = spark.createDataFrame([("a", 5), ("b", 3), ("b", 2)], "k string, at int")
    assert sorted(map(tuple, ledger.insert_ignore(old, new, ["k"], "at").collect())) == [("a", 1), ("b", 2)]
    assert sorted(map(tuple, ledger.upsert(old, new, ["k"], "at").collect())) == [("a", 5), ("b", 3)]


def test_csv_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("x,\"y\"", "1.5"), ("z", "bad"), (None, None)], "s string, v string")
    sinks.csv(df, str(tmp_path / "o"))
    back = tables.csv(spark, str(tmp_path / "o"), ["s"], ["v", "none"], numeric=["v"])
    assert sorted(map(str, (r["s"] for r in back.collect()))) == sorted(["x,\"y\"", "z", "None"])
    assert {r["v"] for r in back.collect()} == {1.5, None} and {r["none"] for r in back.collect()} == {None}
    assert sinks.content_hash(df) == sinks.content_hash(df.repartition(3))
    with pytest.raises(ValueError):
        tables.csv(spark, str(tmp_path / "o"), ["absent"])
    assert tables.synthetic(spark).count() == 600


def draw(seed, rep, place):
    x = (rep * 48271 + place * 16807 + seed * 69621 + 1) % resample.M
    for a, c in ((48271, 11), (69621, 7), (16807, 3)):
        x = (x * a + c) % resample.M
        x = (x + (x >> 13)) % resample.M
    return x


def small_fills(spark):
    return fills(spark, "/root/testdata/sf0.001").toPandas()


def test_within_day_permutation_of_all_rules(spark):
    """Against brute force: all rules, 200 replicates."""
    want = defaultdict(list)
    for (rule, _), rows in small_fills(spark).groupby(["rule", "day"]):
        k, own = int(rows["signal"].sum()), [(int(o), int(n), v) for o, n, v in zip(rows["o"], rows["n"], rows["net_bp"], strict=True)]
        for rep in range(200 if k else 0):
            want[rule, rep] += [v for _, _, _, v in sorted((draw(5, rep, o * 10 + n), o, n, v) for o, n, v in own)[:k]]
    got = {(r["rule"], r["rep"]): r["mean"] for r in catalogue.queries()["within_day_permutation_all_rules"](spark, "/root/testdata/sf0.001").collect()}
    assert len({rule for rule, _ in got}) == 6 and len(got) == 1200 and got.keys() == want.keys()
    assert all(abs(got[k] - sum(map(float, v)) / len(v)) < 2e-6 for k, v in want.items())


def test_resampling_of_whole_days(spark):
    """Bootstrap, pairs and sign flips against brute force over days."""
    rows = small_fills(spark)
    query = lambda name: {r["rule"]: r for r in catalogue.queries()[name](spark, "/root/testdata/sf0.001").collect()}
    boot, pairs, flips = (query(name) for name in ("whole_day_block_bootstrap", "whole_day_matched_pairs", "whole_day_sign_flip"))
    assert len(boot) == len(pairs) == len(flips) == rows["rule"].nunique()
    diffs = {}
    for rule, own in rows.groupby("rule"):
        days = [(int(g["net_bp"].sum()), len(g)) for _, g in own.groupby("day")]
        assert boot[rule]["days"] == len(days) > 500
        means = []
        for rep in range(200):
            picked = [days[draw(7, rep, i) % len(days)] for i in range(len(days))]
            means.append(sum(s for s, _ in picked) / sum(n for _, n in picked))
        assert [boot[rule][c] for c in ("low", "high")] == pytest.approx(np.quantile(means, [0.025, 0.975]).tolist(), abs=2e-6)
        for day, g in own.groupby("day"):
            if 0 < g["signal"].sum() < len(g):
                diffs[rule, day] = g["net_bp"][g["signal"]].mean() - g["net_bp"][~g["signal"]].mean()
    place = {day: i for i, day in enumerate(sorted({day for _, day in diffs}))}
    for rule in pairs:
        own = {day: v for (r, day), v in diffs.items() if r == rule}
        assert (pairs[rule]["pair_days"], pairs[rule]["diff"]) == (len(own), pytest.approx(np.mean(list(own.values())), abs=2e-6))
        v = {day: int(np.floor(abs(x) * 1000 + 0.5) * np.sign(x)) for day, x in own.items()}
        hits = sum(sum(x if (draw(11, rep, place[day]) >> 8) % 2 == 0 else -x for day, x in v.items()) <= sum(v.values()) for rep in range(200))
        assert flips[rule]["p"] == pytest.approx((hits + 1) / 201, abs=2e-6)


def test_models_do_all_rounds_and_tune_the_penalty(spark):
    assert models.pipeline(["a"], "boosting").getStages()[-1].getMaxIter() == 120
    rng = np.random.default_rng(2)
    a = rng.normal(size=400)
    for y, n, want in ((rng.random(400) < 0.5, 400, 0.01), (a > 0, 400, 10.0), (a > 0, 50, 1.0)):
        rows = spark.createDataFrame([(i, i, float(x), int(v)) for i, (x, v) in enumerate(zip(a[:n], y[:n], strict=True))], "id long, at long, a double, y int")
        table = models.placed(rows, rows.select("id", F.lit(1).alias("fold"), F.lit("train").alias("role")), ["a"], [1], "at")
        assert models.Logits(checkpointed(table), ["a"], [1]).chosen == {1: want}


def test_logistic_oof_predicts_five_of_six_blocks(spark):
    sf = "/root/testdata/sf0.001"
    got = catalogue.queries()["logistic_oof"](spark, sf).toPandas()
    blocks = {r["grp"]: r["block"] for r in catalogue.queries()["fold_blocks"](spark, sf).collect()}
    rows = research.frame(spark, sf).select("id", "grp").toPandas()
    assert set(got["fold"]) == {1, 2, 3, 4, 5} and set(got["id"]) == set(rows["id"][rows["grp"].map(blocks) > 0]) and got["id"].is_unique


# ---- nothing is dropped without a word

def test_saturated_ranges_are_told(spark):
    rows = spark.createDataFrame([(i, 0 if i < 1000 else i + 30, "x") for i in range(1040)] + [(5000, None, "y")], "id long, at long, level string")
    found = ledger.bisected(rows, "id", "at", 2048, 50, 4)
    got = found.groupBy("saturated").count().collect()
    assert sorted(map(tuple, got)) == [(False, 40), (True, 1000)] and found.where("saturated").select("level", "part").distinct().collect() == [(4, 0)]
    with pytest.raises(Exception, match="saturated"):
        ledger.complete(found).collect()
    assert ledger.complete(ledger.bisected(rows.where("id >= 1000"), "id", "at", 2048, 50, 6)).count() == 40
    assert ledger.bisected(rows.limit(0), "id", "at", 2048, 50, 4).count() == 0


def test_bars_in_conflict(spark):
    bar = lambda key, at, close: (key, at, 10.0, 12.0, 9.0, close, 5.0)
    bars = spark.createDataFrame([bar("a", 0, 11.0), bar("a", 0, 11.0), bar("a", 5, 10.0), bar("a", 5, 11.0), bar("b", 5, 10.0)], "key string, at long, open double, high double, low double, close double, volume double")
    assert sorted((r["key"], r["at"]) for r in ts.valid_bars(bars, 5, 100).collect()) == [("a", 0), ("b", 5)]
    assert sorted((r["key"], r["at"], r["conflict"]) for r in ts.valid_bars(bars, 5, 100, "flag").collect()) == [("a", 0, False), ("a", 5, True), ("a", 5, True), ("b", 5, False)]
    with pytest.raises(Exception, match="conflicting bars"):
        ts.valid_bars(bars, 5, 100, "raise").collect()
    assert ts.valid_bars(bars.where("at = 0"), 5, 100, "raise").count() == 1
    with pytest.raises(ValueError, match="conflicts"):
        ts.valid_bars(bars, 5, 100, "ignore")


def test_malformed_json_bars_raise(spark, tmp_path):
    (tmp_path / "good").mkdir()
    (tmp_path / "good" / "a.json").write_text('{"key": "a", "rows": [[0, 1, 2, 0.5, 1, 3], [5, 1, 2, 0.5, 1, 3]]}')
    assert tables.json_bars(spark, str(tmp_path / "good")).count() == 2
    for bad in ("[[0, 1, 2, 0.5, 1]]", '[[0, 1, 2, 0.5, 1, "x"]]', "[null]", "null"):
        folder = tmp_path / str(abs(hash(bad)))
        folder.mkdir()
        (folder / "a.json").write_text(f'{{"key": "a", "rows": {bad}}}')
        with pytest.raises(Exception, match="six numbers|FAILED_READ_FILE"):
            tables.json_bars(spark, str(folder)).collect()


def test_draws_in_arrays_and_columns_agree(spark):
    got = spark.range(50).select(resample.draw(9, F.col("id") * 7, F.col("id")).alias("x")).collect()
    assert [r["x"] for r in got] == resample.draws(9, np.arange(50) * 7, np.arange(50)).tolist()


def test_days_beyond_a_tasks_bound_give_the_same_permutation(spark, monkeypatch):
    rows = spark.createDataFrame([(d, i, i % 3 == 0, float(i * i % 17), k) for d in ("d1", "d2", None) for i in range(20) for k in ("a", None)], "day string, n long, signal boolean, v double, k string")
    args = (rows, "day", "signal", ["n"], F.col("v"), 7, 3, F.col("n"), ["k"])
    order = lambda df: sorted(map(str, df.collect()))
    near = order(resample.within_day_permutation(*args))
    monkeypatch.setattr(resample, "MOST_ROWS", 5)
    assert order(resample.within_day_permutation(*args)) == near and len(near) == 14


# ---- larger tables

def test_spearman_of_large_keys(spark, monkeypatch):
    """Against ranks by pandas, ties, nulls and one value only included; no window holds a key's rows, broadcast or not."""
    rng = np.random.default_rng(4)
    data = [(["x", "y", None][i % 3], None if i % 11 == 0 else float(a), float(b)) for i, (a, b) in enumerate(zip(rng.integers(0, 9, 600), rng.integers(-50, 50, 600), strict=True))]
    rows = spark.createDataFrame([*data, ("one", 1.0, 2.0), ("flat", 1.0, 2.0), ("flat", 1.0, 3.0)], "k string, a double, b double")
    own = pd.DataFrame(data, columns=["k", "a", "b"]).fillna({"a": -1.0, "k": "null"})
    want = {k: g["a"].rank().corr(g["b"].rank()) for k, g in own.groupby("k")}
    for most in (100_000, 0):
        monkeypatch.setattr(stats, "MOST_BROADCAST", most)
        found = stats.spearman(rows, ["k"], "a", "b")
        assert "windowspecdefinition(k#" not in found._jdf.queryExecution().toString()
        got = {r["k"] or "null": r["rho"] for r in found.collect()}
        assert got.pop("one") is None and got.pop("flat") is None and got == pytest.approx(want, abs=1e-12)
    whole = own["a"].rank().corr(own["b"].rank())
    assert stats.spearman(rows.where("k IS NULL OR k IN ('x', 'y')"), [], "a", "b").first()["rho"] == pytest.approx(whole, abs=1e-12)


def test_draws_of_a_day_are_the_same_and_faster(spark):
    """Against `draws` and a stable sort, equal draws, long days and unknown values included."""
    rng = np.random.default_rng(1)
    for n, k in ((1, 1), (3, 2), (40, 40), (2400, 1600), (40_000, 9)):
        place, rep = rng.integers(0, 5_000_000_000, n), np.arange(30)
        assert (resample.draw_table(5, rep, place) == resample.draws(5, rep[:, None], place[None, :])).all()
        few = resample.draw_table(5, rep, place) % max(2, n // 2)
        want = np.zeros(few.shape, bool)
        np.put_along_axis(want, np.argsort(few, axis=1, kind="stable")[:, :k], True, 1)
        assert (resample.smallest(few, k) == want).all()
    place, rep = rng.integers(0, 5_000_000_000, 2400), np.arange(100)

    def seconds(work):
        began = time.perf_counter()
        work()
        return time.perf_counter() - began

    sorting, taking = (min(seconds(w) for _ in range(3)) for w in (lambda: np.argsort(resample.draws(5, rep[:, None], place[None, :]), axis=1, kind="stable"), lambda: resample.smallest(resample.draw_table(5, rep, place), 1600)))
    assert taking < sorting / 2
    rows = spark.createDataFrame([(i, i % 3 > 0, None if i % 4 == 0 else float("inf") if i == 1 else float(i)) for i in range(40)], "n long, signal boolean, v double").withColumn("day", F.lit("d"))
    drawn = {rep: sorted((draw(3, rep, i), i) for i in range(40))[:26] for rep in range(20)}
    values = {rep: [float("inf") if i == 1 else float(i) for _, i in of if i % 4] for rep, of in drawn.items()}
    got = {r["rep"]: r["mean"] for r in resample.within_day_permutation(rows, "day", "signal", ["n"], F.col("v"), 20, 3, F.col("n")).collect()}
    assert got == pytest.approx({rep: sum(v) / len(v) for rep, v in values.items()}) and len(set(got.values())) > 2


def test_logistic_fits_see_rows_that_are_alike_once(spark):
    """Weights of alike rows give what every row alone gives, and copies of a table add none."""
    rng = np.random.default_rng(6)
    data = [(i, i, float(a), int(v)) for i, (a, v) in enumerate(zip(rng.integers(0, 4, 400), rng.random(400) < 0.4, strict=True))]

    def fitted(own):
        rows = spark.createDataFrame(own, "id long, at long, a double, y int")
        members = rows.select("id", F.explode(F.array(F.lit(1), F.lit(2))).alias("fold"), F.when(F.col("id") % 5 == 0, "test").otherwise("train").alias("role"))
        return models.Logits(checkpointed(models.placed(rows, members, ["a"], [1, 2], "at")), ["a"], [1, 2])

    one, many = fitted(data), fitted([(i * 10 + k, at, a, y) for i, at, a, y in data for k in range(10)])
    assert one.alike.count() <= 2 * 4 * 5 and one.alike.agg(F.sum("__rows")).first()[0] == 400 and many.alike.count() <= 2 * 4 * 5
    x, y = np.array([a for i, _, a, _ in data if i % 5]), np.array([v for i, _, _, v in data if i % 5])
    got = {ks: (one.fits.n[i], one.fits.positive[i]) for i, ks in enumerate(one.of) if ks[2] == 1.0}
    assert got == {(k, s, 1.0): (u, y[:u].sum()) for k in (1, 2) for s, u in ((-1, 320), (0, 80), (1, 160), (2, 240))}
    p = one.fits.probabilities(x[:, None])[:240, one.of.index((1, 2, 0.1))]
    assert (p - y[:240]).sum() == pytest.approx(0, abs=1e-6)  # the intercept of the split's fit is free
    told = one.told(inner=False).collect()
    assert {(r["fold"], r["id"]) for r in told} == {(k, i) for k in (1, 2) for i in range(0, 400, 5) if k == 2} and {(r["split"], r["role"]) for r in told} == {(-1, "test")}
