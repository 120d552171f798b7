"""Folds by hand, streams in one batch and in many against the same fold over the table, and sinks whose batches come again."""

import pickle
import random

import pytest
from pyspark.sql import functions as F

from driftline.operators import folds
from driftline.operators.folds import HOUR
from driftline.streaming import sinks, stateful

MINUTE = 60_000


def after(fold, rows, now=None):
    """What a fold makes of one key's rows."""
    state, out = None, []
    for i, row in enumerate(rows):
        row = {"id": i} | row
        state, early = fold.until(state, row["at"], False)
        state, more = fold.step(state, row)
        out += early + more
    if now is not None:
        state, more = fold.until(state, now, True)
        out += more
    return state, out


def test_refused_requests_use_nothing_up():
    ask = lambda at, token, fresh=True: {"at": at, "token": token, "fresh": fresh, "until": at + 100}
    rows = [ask(0, "a"), ask(10, "a"), ask(20, "b"), ask(30, "c"), ask(99, "c"), ask(100, "c"), ask(110, "a"), ask(119, "d", False), ask(120, "a")]
    state, out = after(folds.Admission(2), rows, 1000)
    assert [(i, reason) for i, _, _, reason in out] == [(0, None), (1, "token"), (2, None), (3, "limit"), (4, "limit"), (5, None), (6, "limit"), (7, "stale"), (8, None)]
    assert state is None


def test_outcome_is_complete_by_the_clock():
    price = lambda at, p: {"at": at, "price": p}
    fold = folds.Outcome(0.9, 1.1, 1.5)
    state, out = after(fold, [price(0, 100.0), price(1, 90.0), price(2, 111.0), price(3, None), price(24 * HOUR, 151.0)])
    assert out == [] and state is not None
    assert after(fold, [price(0, 100.0), price(1, 90.0), price(2, 111.0), price(24 * HOUR, 151.0)], 24 * HOUR) == (None, [(0, 100.0, 90.0, 151.0, "stop", 1, 2, 24 * HOUR, 4)])
    _, out = after(fold, [price(0, 100.0), price(5, 112.0), price(6, 80.0), price(24 * HOUR + 1, 50.0)])
    assert out == [(0, 100.0, 80.0, 112.0, "tp1", None, 5, None, 3)]
    with pytest.raises(ValueError, match="levels"):
        folds.Outcome(1.1, 1.2, 1.3)


def test_all_kinds_of_position_events_each_once():
    row = lambda at, p, liq=50_000.0: {"at": at, "price": p, "liquidity": liq}
    rows = [row(0, 100.0), row(1, 99.0, 9_000.0), row(2, 98.0, 9_000.0), row(3, 151.0), row(4, 200.0), row(5, 141.0), row(6, 140.0), row(7, 100.0), row(8, 50.0), row(9, 10.0), row(10, 40.0)]
    _, out = after(folds.Position(0.5, 1.5, 4.0, 30.0), rows)
    assert [(since, at, kind) for since, at, kind, *_ in out] == [(0, 1, "liquidity"), (0, 3, "tp1"), (0, 6, "trail"), (7, 8, "stop"), (9, 10, "tp2")]
    assert out[2][4] == 200.0 * (1 - 30.0 / 100)
    _, out = after(folds.Position(0.5, 1.5, None, None), [row(0, 100.0), row(1, 160.0), row(2, 500.0), row(3, 100.0)])
    assert [kind for _, _, kind, *_ in out] == ["tp1", "breakeven"]


def test_coverage_and_delivery_by_hand():
    see = lambda at, gap=False: {"at": at, "gap": gap}
    _, out = after(folds.Coverage(60, 2), [see(0, True), see(10), see(59), see(61), see(70, True), see(75, True)], 1000)
    assert out == [(0, "warming"), (60, "healthy"), (63, "stale"), (70, "warming"), (135, "stale")]
    wish = lambda at, to: {"at": at, "to": to}
    _, out = after(folds.Delivery(60, 120, 1000), [wish(0, "sent"), wish(1, "reserved"), wish(2, "reserved"), wish(61, "sending"), wish(62, "sent")], 500)
    assert out == [(1, 1, "reserved"), (None, 121, "unknown")]
    _, out = after(folds.Delivery(60, 120, 10), [wish(1, "reserved"), wish(2, "sending"), wish(3, "failed"), wish(4, "reserved"), wish(14, "reserved")], 20)
    assert out == [(0, 1, "reserved"), (1, 2, "sending"), (2, 3, "failed"), (4, 14, "reserved")]


def test_folds_of_tables_with_nulls_ties_and_no_rows(spark):
    rows = [(None, 5, 1, 10.0), (None, 5, None, 4.0), ("a", None, 2, 1.0), ("a", 5, 3, 10.0), ("a", 5, 3, 10.0), ("a", 6, 4, None), ("a", 7, 5, float("nan"))]
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], "k string, at long, id long, price double, since string, state string")
    got = folds.folded(df, ["k"], folds.Outcome(0.5, 1.5, 2.0), 100 * HOUR)
    assert sorted((str(r["k"]), r["since"], r["first_hit"], r["n"]) for r in got.collect()) == [("None", 5, "tp1", 2), ("a", 5, None, 2)]  # null ids come first
    assert folds.folded(df.limit(0), ["k"], folds.Outcome(0.5, 1.5, 2.0)).count() == 0


STEPS = "user long, ts timestamp, id long, price double, liquidity double, token string, fresh boolean, until long"


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    """Rows of twelve keys over six days in five files, out of order within each, and in one file; a last row far ahead ends all."""
    rng = random.Random(8)
    rows, price = [], dict.fromkeys(range(12), 100.0)
    for i in range(1500):
        user, at = rng.randrange(12), i * 350_000 + rng.randrange(300_000)
        price[user] = max(1.0, price[user] * rng.uniform(0.55, 1.7))
        rows.append((user, at, i, price[user], rng.uniform(5_000, 60_000), rng.choice("abcd"), rng.random() < 0.9, at + 24 * HOUR))
    frame = spark.createDataFrame(rows, STEPS.replace("ts timestamp", "at long")).withColumn("ts", F.timestamp_millis("at"))
    names = [f.split()[0] for f in STEPS.split(", ")]
    base = tmp_path_factory.mktemp("steps")
    last = spark.createDataFrame([(99, 40 * 24 * HOUR, 9999, 1.0, 1.0, "z", True, 0)], STEPS.replace("ts timestamp", "at long")).withColumn("ts", F.timestamp_millis("at")).select(*names)
    many, one = str(base / "many"), str(base / "one")
    for part in range(5):
        frame.where(f"id div 300 = {part}").select(*names).orderBy(F.rand(1)).coalesce(1).write.mode("append").parquet(many)
    last.coalesce(1).write.mode("append").parquet(many)
    frame.select(*names).orderBy(F.rand(2)).unionByName(last).coalesce(1).write.parquet(one)
    return frame.where("at IS NOT NULL"), many, one


@pytest.mark.parametrize("fold", [folds.Position(0.5, 1.5, 3.0, 30.0), folds.Position(0.5, 1.5, None, None), folds.Outcome(0.7, 1.4, 2.0), folds.Admission(3)], ids=["trail", "breakeven", "outcome", "admission"])
def test_streams_in_one_batch_and_in_many(spark, steps, tmp_path, fold):
    table, many, one = steps
    want = sorted(map(str, folds.folded(table, ["user"], fold, 40 * 24 * HOUR).collect()))
    assert len(want) > 20
    for folder in (one, many):
        frame = spark.readStream.schema(STEPS).option("maxFilesPerTrigger", 1).parquet(folder)
        name = folder.rsplit("/", 1)[1]
        query = stateful.folded(frame, ["user"], fold).writeStream.format("parquet").option("path", str(tmp_path / f"{name}-out")).option("checkpointLocation", str(tmp_path / f"{name}-state")).trigger(availableNow=True).start()
        query.awaitTermination()
        got = spark.read.parquet(str(tmp_path / f"{name}-out")).where("user <> 99")
        assert sorted(map(str, got.collect())) == want
        assert len([p for p in query.recentProgress if p.numInputRows]) == (1 if folder == one else 6)
        if isinstance(fold, folds.Outcome | folds.Admission):  # positions stay open until a price ends them
            assert query.lastProgress.stateOperators[0].numRowsTotal <= 4  # what the last row waits for
    if isinstance(fold, folds.Position):
        kinds = {r["kind"] for r in folds.folded(table, ["user"], fold).select("kind").distinct().collect()}
        assert kinds == ({"stop", "tp1", "tp2", "trail", "liquidity"} if fold.trail else {"tp1", "breakeven", "liquidity"})


ROWS = "id long, user long, at long"
SEEN = "user long, first_seen long, last_seen long"


def batch(spark, *rows):
    return spark.createDataFrame(list(rows), ROWS)


def state(spark, log, seen):
    return sorted(map(tuple, log.read(spark).collect())), sorted(map(tuple, seen.read(spark).collect()))


def test_batches_that_come_again_change_nothing(spark, tmp_path):
    log, seen = sinks.Log(str(tmp_path / "log"), ROWS), sinks.Table(str(tmp_path / "seen"), SEEN)
    write = sinks.insert_with_seen(log, seen, ["id"], ["at"], ["user"])
    first, second = batch(spark, (1, 7, 100), (1, 7, 90), (2, 8, 50)), batch(spark, (1, 7, 1), (3, 7, 300), (4, 9, 5))
    write(first, 0)
    write(second, 1)
    want = state(spark, log, seen)
    assert want == ([(1, 7, 90), (2, 8, 50), (3, 7, 300), (4, 9, 5)], [(7, 90, 300), (8, 50, 50), (9, 5, 5)])  # row (1, 7, 1) was not new
    write(second, 1)
    assert state(spark, log, seen) == want
    write(batch(spark), 2)
    assert state(spark, log, seen) == want


def test_a_crash_between_two_writes(spark, tmp_path, monkeypatch):
    log, seen = sinks.Log(str(tmp_path / "log"), ROWS), sinks.Table(str(tmp_path / "seen"), SEEN)
    write = sinks.insert_with_seen(log, seen, ["id"], ["at"], ["user"])
    write(batch(spark, (1, 7, 100)), 0)
    monkeypatch.setattr(sinks.Table, "write", lambda *_: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError, match="lost"):
        write(batch(spark, (2, 7, 50), (3, 7, 300)), 1)
    monkeypatch.undo()
    write(batch(spark, (2, 7, 50), (3, 7, 300)), 1)
    assert state(spark, log, seen) == ([(1, 7, 100), (2, 7, 50), (3, 7, 300)], [(7, 50, 300)])


def test_hints_leave_first_times(spark, tmp_path):
    log, seen = sinks.Log(str(tmp_path / "log"), ROWS), sinks.Table(str(tmp_path / "seen"), SEEN, keep=1)
    write = sinks.insert_with_seen(log, seen, ["id"], ["at"], ["user"], first_too=False)
    write(batch(spark, (1, 7, 100)), 0)
    write(batch(spark, (2, 7, 50), (3, 8, 300), (4, 8, 200)), 1)
    assert state(spark, log, seen)[1] == [(7, 100, 100), (8, 200, 300)] and sinks.listed(spark, seen.path) == [1]


def test_upsert_sink(spark, tmp_path):
    table = sinks.Table(str(tmp_path / "t"), ROWS)
    write = sinks.upsert(table, ["id"], "at")
    write(batch(spark, (1, 7, 100), (2, 7, 5)), 0)
    write(batch(spark, (1, 8, 90), (2, 9, 6), (3, 1, 1)), 1)
    write(batch(spark, (1, 8, 90), (2, 9, 6), (3, 1, 1)), 1)
    assert sorted(map(tuple, table.read(spark).collect())) == [(1, 7, 100), (2, 9, 6), (3, 1, 1)]


class Store(dict):
    """A key's values and pieces as a processor sees them; counts the pieces in it."""

    def __init__(self):
        self.most = 0

    def updateValue(self, place, value):
        self[place] = value
        self.most = max(self.most, len(self))

    def getValue(self, place):
        return self[place]

    removeKey = dict.pop


def test_rows_of_a_large_key_wait_in_pieces_that_open_when_due(spark, monkeypatch):
    monkeypatch.setattr(stateful, "BATCH", 64)
    monkeypatch.setattr(stateful, "PIECE", 8)
    folded, pieces = stateful.Folded(folds.Coverage(HOUR, HOUR), ["source"]), Store()
    folded.pieces = pieces
    rows = [(t // 2, t % 3 and t, False) for t in range(1000)]
    shuffled = random.Random(3).sample(rows, 1000)
    places, upto = [], 250
    for i in range(0, 1000, 64):
        some = sorted(shuffled[i : i + 64], key=stateful.order)
        places += [folded.put(some[j : j + 8]) for j in range(0, len(some), 8)]
    few = [(0, -1, True), (250, 9999, True)]
    opened = []
    left = sorted(places)
    for row in folded.due(left, few, upto):
        opened.append(row)
    assert opened == sorted([r for r in rows if r[0] <= upto] + few, key=stateful.order)
    assert sorted(r for p in left for r in pickle.loads(pieces[p][0])) == sorted(r for r in rows if r[0] > upto) and sorted(left) == sorted(pieces)
