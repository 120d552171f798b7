"""Signal families against a computation from each bar's whole past, by hand, over holes, and as a stream's fold."""

import math
import random

import pytest

from driftline.operators import signals, timeseries
from driftline.operators.signals import Trend, Zone

BAR = 300_000
VARIANTS = [*signals.RECLAIM_FAMILY, *signals.TREND_FAMILY, *signals.EAGER_FAMILY]


def walk(seed, n):
    """Bars of a random walk that swings, so that supports are touched and reclaimed."""
    rng = random.Random(seed)
    out, price = [], 100.0
    for i in range(n):
        points = [price]
        for _ in range(4):
            price *= math.exp(rng.gauss(0.0008 * math.sin(i / 23), 0.008))
            points.append(price)
        out.append({"at": i * BAR, "open": points[0], "high": max(points), "low": min(points), "close": price, "volume": rng.expovariate(1 / 100)})
    return out


def by_definition(bars, x):
    """(bar, entry, stop) of each signal, each condition taken anew from the list of all bars before."""
    mean = lambda v: sum(v) / len(v)
    fast, slow = [bars[0]["close"]], [bars[0]["close"]]
    for b in bars[1:]:
        fast.append(b["close"] * 2 / 10 + fast[-1] * 8 / 10)
        slow.append(b["close"] * 2 / 22 + slow[-1] * 20 / 22)
    found, arm, last = [], None, None
    for i, b in enumerate(bars):
        if i < (55 if isinstance(x, Trend) else 79):
            continue
        c, sma, ratio = b["close"], mean([y["close"] for y in bars[i - 49 : i + 1]]), b["volume"] / mean([y["volume"] for y in bars[i - 20 : i]])
        place = (c - b["low"]) / (b["high"] - b["low"])
        if isinstance(x, Trend):
            stop = min(y["low"] for y in bars[i - 4 : i + 1]) * 0.995
            trend = c > sma and fast[i] > slow[i] > slow[i - 3] and (slow[i] > sma or not x.ordered)
            dip = any(bars[j]["low"] <= slow[j] * 1.01 for j in range(i - 8, i))
            reclaim = bars[i - 1]["close"] <= fast[i - 1] * 1.005 and c > fast[i] and c > bars[i - 1]["high"]
            strong = c > b["open"] and place >= 0.65 and ratio >= x.volume and c / slow[i] - 1 <= 0.06 and 0.015 <= 1 - stop / c <= x.most_risk
            if trend and dip and reclaim and strong and (last is None or i - last >= 72):
                found.append((i, c, stop))
                last = i
            continue
        if arm:
            arm["below"] = arm["below"] + 1 if c < arm["lower"] else 0
            if i - arm["since"] > 72 or arm["below"] == 2:
                arm = None
        past = bars[max(0, i - 288) : i]
        if not arm and c < x.pullback * max(y["high"] for y in past) and (slow[i] < sma or not x.falling):
            pivots = [j for j in range(max(3, i - 288), i - 11) if all(bars[k]["low"] > bars[j]["low"] for k in range(j - 3, j + 4) if k != j)]
            for j in reversed(pivots):
                peers = [k for k in pivots if abs(k - j) >= 6 and abs(bars[k]["low"] / bars[j]["low"] - 1) <= 0.04]
                if peers:
                    level = (bars[j]["low"] + bars[max(peers)]["low"]) / 2
                    if b["low"] <= level * 1.035 and b["high"] >= level * 0.975 and c >= level * 0.975:
                        arm = {"lower": level * 0.975, "upper": level * 1.035, "since": i, "below": 0}
                        break
        if arm:
            bound, stop = (arm["lower"] + arm["upper"]) / 2 if x.middle else arm["upper"], arm["lower"] * 0.995
            more = (lambda a, y: a > y) if x.strict else (lambda a, y: a >= y)
            if (
                c > b["open"] and more(c, bound) and c <= arm["upper"] * x.reach and ratio >= x.volume and place >= x.close_position and c > fast[i] > fast[i - 1]
                and more(fast[i], x.ema_ratio * slow[i]) and (c > sma or not x.above_sma) and 1 - stop / c <= x.most_risk
            ):
                found.append((i, c, stop))
                arm = None
    return found


def through(fold, bars):
    state, out = None, []
    for b in bars:
        state, more = fold.step(state, b)
        out += more
    return out, state


def test_every_variant_equals_its_definition():
    total = dict.fromkeys(("reclaim", "trend", "eager"), 0)
    for seed in range(2):
        bars = walk(seed, 800)
        out, _ = through(signals.Signals(VARIANTS, BAR), bars)
        for k, x in enumerate(VARIANTS):
            want = by_definition(bars, x)
            assert [(at // BAR - 1, entry, stop) for v, at, entry, stop, *_ in out if v == k] == [(i, c, pytest.approx(s, rel=1e-12)) for i, c, s in want]
            total["trend" if isinstance(x, Trend) else "reclaim" if x.falling else "eager"] += len(want)
    assert all(n > 10 for n in total.values()), total


def support_bars(volume=220.0):
    close = [11.0] * 50 + [11 - 0.9 * i / 19 for i in range(20)] + [10.1] * 41 + [10.05, 10.12, 10.2, 10.4]
    bars = [(c, c + 0.03, c - 0.03, c, 100.0) for c in close]
    for j in (75, 90):
        bars[j] = (10.1, 10.13, 9.9, 10.1, 100.0)
    bars[-1] = (10.2, 10.42, 10.18, 10.4, volume)
    return [dict(zip(("open", "high", "low", "close", "volume"), b, strict=True)) | {"at": i * BAR} for i, b in enumerate(bars)]


def test_support_is_rejected_once():
    fold, bars = signals.Signals([signals.SUPPORT], BAR), support_bars()
    out, _ = through(fold, bars)
    (signal,) = out
    assert signal[1] == len(bars) * BAR and signal[6] == 90 * BAR and signal[7:10] == (pytest.approx(9.9 * 0.975), pytest.approx(9.9 * 1.035), 2) and signal[-1]
    assert through(fold, bars[:-1])[0] == [] and through(fold, support_bars(100.0))[0] == []
    longer = bars + [b | {"at": (len(bars) + i) * BAR} for i, b in enumerate(bars[-5:])]
    assert [x for x in through(fold, longer)[0] if x[1] <= len(bars) * BAR] == out


def test_eight_conditions_are_the_signal(spark):
    rows = [(k, b["at"], *(b[c] for c in ("open", "high", "low", "close", "volume"))) for k, seed in (("a", 21), ("b", 22)) for b in walk(seed, 900)]
    bars = spark.createDataFrame(rows, "k string, at long, open double, high double, low double, close double, volume double")
    armed = signals.find(bars, ["k"], [signals.SUPPORT], BAR, every=True)
    got = signals.conditions(bars, armed, ["k"], BAR).collect()
    assert len(got) == armed.count() > 100 and all(r["holds"] == r["fired"] for r in got)
    assert {(r["k"], r["at"]) for r in got if r["fired"]} == {(r["k"], r["at"]) for r in signals.find(bars, ["k"], [signals.SUPPORT], BAR).collect()} != set()
    assert {r["at"] - r["age"] * BAR for r in got if r["age"] == 0} and all(0 <= r["age"] <= 72 and r["below"] < 2 and r["tests"] >= 2 for r in got)
    for name in ("green", "close_in_zone", "volume", "strong_close", "above_ema9", "ema9_rising", "ema_alignment", "low_risk"):
        assert {r[name] for r in got} <= {True, False}


def test_signals_are_causal_and_state_is_bounded():
    bars = walk(5, 1000)
    fold = signals.Signals(VARIANTS, BAR)
    out, state = through(fold, bars)
    early, _ = through(fold, bars[:700])
    assert early == [x for x in out if x[1] <= 700 * BAR] and early
    assert max(len(x) for x in state if isinstance(x, list)) <= max(signals.LOOK_BACK, len(VARIANTS))


def test_a_hole_starts_anew():
    bars = walk(7, 1000)
    fold = signals.Signals(VARIANTS, BAR)
    later = [b | {"at": b["at"] + BAR} for b in bars[400:]]
    tail, _ = through(fold, later)
    whole, _ = through(fold, bars[:400] + later)
    assert [x for x in whole if x[1] > 401 * BAR] == tail and tail
    for bad in ({"close": None}, {"low": 0.0}, {"volume": None}):
        got, _ = through(fold, [*bars[:399], bars[399] | bad, *bars[400:]])
        assert [(x[0], x[1] + BAR, *x[2:6]) for x in got if x[1] > 400 * BAR] == [x[:6] for x in tail]


def test_find_and_outcomes_over_tables(spark):
    rows = [(k, b["at"], *(b[c] for c in ("open", "high", "low", "close", "volume"))) for k in ("a", "b", None) for b in walk(11 if k == "a" else 12, 600)]
    bars = spark.createDataFrame(rows, "k string, at long, open double, high double, low double, close double, volume double").repartition(7)
    found = signals.find(bars, ["k"], VARIANTS, BAR)
    got = sorted((r["k"] or "", r["variant"], r["at"]) for r in found.collect())
    want = [(k, v, at) for k, seed in (("a", 11), ("b", 12), ("", 12)) for v, at, *_ in through(signals.Signals(VARIANTS, BAR), walk(seed, 600))[0]]
    assert got == sorted(want) and got
    assert signals.find(bars.limit(0), ["k"], VARIANTS, BAR).count() == 0


def test_what_comes_first(spark):
    bars = spark.createDataFrame(
        [("t", 0, 101.0, 99.0, 100.0), ("t", 1, 106.0, 99.0, 105.0), ("t", 2, 111.0, 100.0, 110.0), ("s", 0, 101.0, 90.0, 95.0), ("s", 1, 120.0, 99.0, 100.0), ("x", 0, 106.0, 90.0, 100.0), ("o", 9, 104.0, 99.0, 103.0), ("o", 10, 200.0, 1.0, 50.0)],
        "k string, at long, high double, low double, close double",
    )
    sig = spark.createDataFrame([(k, v, 0, 100.0, 95.0, 0.05, 2.0) for k in ("t", "s", "x", "o", "none") for v in (0, 3)], "k string, variant int, at long, entry double, stop double, risk double, ratio double")
    out = signals.outcomes(sig, bars, ["k"], (0.05, 0.1), 10)
    got = {(r["k"], r["target"]): (r["result"], r["hit_at"], r["return_pct"]) for r in out.where("variant = 3").collect()}
    assert got == {
        ("t", 0.05): ("target", 1, None), ("t", 0.1): ("target", 2, None), ("s", 0.05): ("stop", 0, None), ("s", 0.1): ("stop", 0, None), ("x", 0.05): ("ambiguous", 0, None), ("x", 0.1): ("stop", 0, None),
        ("o", 0.05): ("open", None, pytest.approx(3.0)), ("o", 0.1): ("open", None, pytest.approx(3.0)),
    }
    counted = {(r["variant"], r["target"]): (r["signals"], r["targets"], r["stops"], r["ambiguous"], r["open"]) for r in signals.counts(out).collect()}
    assert counted[(0, 0.05)] == counted[(3, 0.05)] == (4, 1, 1, 1, 1) and counted[(0, 0.1)] == (4, 1, 2, 0, 1)


def test_tick_bars(spark):
    t = spark.createDataFrame([("a", i, 10 - i, float(i), 1.0) for i in range(7)], "k string, id long, at long, price double, usd double")
    got = [tuple(r) for r in timeseries.tick_bars(t, ["k"], 3, 100).orderBy("at").collect()]
    assert got == [("a", 0, 6.0, 6.0, 4.0, 4.0, 3.0, 3), ("a", 100, 3.0, 3.0, 1.0, 1.0, 3.0, 3)]


def test_zone_thresholds_are_data():
    assert (len(signals.RECLAIM_FAMILY), len(signals.TREND_FAMILY), len(signals.EAGER_FAMILY)) == (12, 18, 96)
    assert {type(x) for x in VARIANTS} == {Zone, Trend} and len(set(VARIANTS)) == len(VARIANTS)
