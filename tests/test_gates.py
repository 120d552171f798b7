"""Each gate by hand: the one reason it gives, unknown numbers, a missing market; the score's parts from their formulas."""

import pytest
from pyspark.sql import functions as F

from driftline.operators import gates

NOW = 1_700_000_000_000
GOOD = {
    "at": NOW, "covered": True, "tradeable": True, "security": "PASS", "security_reasons": "", "checked_at": NOW - 60_000, "market": True, "matches": True, "created_at": NOW - 600_000, "fetched_at": NOW, "pool": "p", "liquidity": 150_000.0, "min_liquidity": 50_000,
    "fdv": 1_500_000.0, "price": 2.0, "price_change": 25.0, "volume": 25_000.0, "buys": 60, "sells": 50, "buyers": 50, "usd_ratio": 1.75, "top_buyer": 0.2, "top_five": 0.24, "previous_volume": 10_000.0, "preceding_volume": 5_000.0, "minute_share": 0.35, "flow_change": None,
    "higher_lows": True, "ema21": 1.9, "sma50": 1.8, "pullback": 0.05, "rule": "v2", "before_at": NOW - 180_000, "before_rule": "v2", "before_pool": "p", "before_liquidity": 150_000.0,
}
SCHEMA = (
    "case int, at long, covered boolean, tradeable boolean, security string, security_reasons string, checked_at long, market boolean, matches boolean, created_at long, fetched_at long, pool string, liquidity double, min_liquidity long, fdv double, price double, price_change double, volume double, buys long, sells long, "
    "buyers long, usd_ratio double, top_buyer double, top_five double, previous_volume double, preceding_volume double, minute_share double, flow_change double, higher_lows boolean, ema21 double, sma50 double, pullback double, rule string, before_at long, before_rule string, before_pool string, before_liquidity double"
)
NAN, INF = float("nan"), float("inf")
MARKET = ("created_at", "fetched_at", "pool", "liquidity", "fdv", "price", "price_change", "matches")
CASES = [
    ({}, []), ({"covered": False}, [gates.UNCOVERED]), ({"covered": None}, [gates.UNCOVERED]), ({"tradeable": False}, [gates.UNTRADEABLE]), ({"security": "REJECT", "security_reasons": "a, b"}, ["Security REJECT: a, b"]), ({"security": None, "security_reasons": None}, ["Security UNKNOWN: "]),
    ({"checked_at": NOW - 60_001}, [gates.SECURITY_STALE]), ({"checked_at": NOW + 1}, [gates.SECURITY_STALE]), ({"checked_at": None}, [gates.SECURITY_STALE]), ({"market": False}, [gates.NO_MARKET]), ({"market": False} | dict.fromkeys(MARKET), [gates.NO_MARKET]),
    ({"market": None} | dict.fromkeys(MARKET), [gates.NO_MARKET]), ({"volume": 9_999.0}, [gates.LOW_VOLUME]), ({"volume": NAN}, [gates.LOW_VOLUME]), ({"buys": 20, "sells": 9}, [gates.FEW_SWAPS]), ({"buyers": 19}, [gates.FEW_BUYERS]), ({"buys": 59}, [gates.COUNT_RATIO]), ({"sells": 0}, []),
    ({"usd_ratio": 1.29}, [gates.USD_RATIO]), ({"usd_ratio": None}, [gates.USD_RATIO]), ({"usd_ratio": NAN}, [gates.USD_RATIO]), ({"usd_ratio": INF}, []), ({"top_buyer": 0.21}, [gates.ONE_BUYER]), ({"top_five": 0.61}, [gates.FIVE_BUYERS]), ({"top_five": None}, [gates.FIVE_BUYERS]), ({"matches": False}, [gates.MISMATCH]),
    ({"created_at": NOW - 599_999}, [gates.AGE]), ({"created_at": NOW - 86_400_001}, [gates.AGE]), ({"created_at": None}, [gates.AGE]), ({"fetched_at": NOW - 60_001}, [gates.MARKET_STALE]), ({"fetched_at": NOW + 1}, [gates.MARKET_STALE]),
    ({"liquidity": 49_999.0, "fdv": 1.0, "before_at": None}, [gates.LOW_LIQUIDITY]), ({"liquidity": NAN}, [gates.LOW_LIQUIDITY, gates.VALUATION]), ({"fdv": 0.0}, [gates.VALUATION]), ({"fdv": 3_000_001.0}, [gates.VALUATION]), ({"fdv": INF}, [gates.VALUATION]), ({"price": 0.0}, [gates.PRICE]), ({"price": NAN}, [gates.PRICE]),
    ({"price_change": 25.1}, [gates.EXTENDED]), ({"price_change": None}, [gates.EXTENDED]), ({"flow_change": 26.0}, [gates.EXTENDED]), ({"before_liquidity": 170_000.0}, [gates.DRAINED]), ({"before_liquidity": 170_000.0, "before_at": NOW - 180_001}, []), ({"before_liquidity": 170_000.0, "before_rule": "v1"}, []),
    ({"before_liquidity": 170_000.0, "before_pool": "q"}, []), ({"before_liquidity": None, "before_at": None, "before_pool": None, "before_rule": None}, []), ({"covered": False, "buyers": 1, "price": 0.0}, [gates.UNCOVERED, gates.FEW_BUYERS, gates.PRICE]),
    ({"higher_lows": False, "ema21": None, "pullback": None, "preceding_volume": 0.0, "minute_share": 0.9, "usd_ratio": 1.3, "buyers": 20, "top_five": 0.6, "fdv": 3_000_000.0}, [gates.LOW_SCORE]),
]


@pytest.fixture(scope="module")
def told(spark):
    names = [f.split()[0] for f in SCHEMA.split(", ")][1:]
    rows = spark.createDataFrame([(i, *((GOOD | change)[n] for n in names)) for i, (change, _) in enumerate(CASES)], SCHEMA)
    return {r["case"]: r for r in gates.evaluate(rows).collect()}


@pytest.mark.parametrize("case", range(len(CASES)))
def test_reasons(told, case):
    row, reasons = told[case], CASES[case][1]
    assert row["reasons"] == reasons, CASES[case][0]
    assert row["qualifies"] == (not reasons)
    assert (row["score"] is None) == (reasons not in ([], [gates.LOW_SCORE])) and (row["score"] is not None or row["why"] == [])


def test_score_by_hand(told):
    row = told[0]
    # 10 + 6.67 + 5; 5 + 4 + 4.2; 10 + 5 + 5; all of structure; 8 + 4.67
    assert [row[f"{p}_points"] for p in gates.PARTS] == [22, 13, 20, 15, 13] and row["score"] == 83 and row["why"] == gates.WHY
    assert told[44]["liquidity_points"] == told[45]["liquidity_points"] == 19


def test_queries_meet_all_reasons(spark):
    from driftline.plans import reports

    rows = reports.evaluate_gates(spark, "/root/testdata/sf0.01").select(F.explode(F.split("reasons", "; ")).alias("r")).distinct().collect()
    assert len({r["r"].split(":")[0] for r in rows if r["r"]}) >= 20


def test_no_rows(spark):
    assert gates.evaluate(spark.createDataFrame([], SCHEMA)).count() == 0
