"""Wallet swaps by hand, and 256-bit numbers against Python's."""

import json
import random
from decimal import ROUND_HALF_UP, Context, Decimal

import pytest
from pyspark.sql import functions as F

from driftline.operators import wallets


def test_large_numbers(spark):
    rng = random.Random(1)
    values = [0, 1, 9, 10**9, 2**32 - 1, 2**32, 2**63, 2**64, 2**128 - 1, 2**128, 2**255, 2**256 - 1, *(rng.getrandbits(rng.randint(1, 256)) for _ in range(200))]
    groups = [(i // 4, hex(v), rng.choice([-1, 1])) for i, v in enumerate(values)]
    df = spark.createDataFrame(groups, "g long, x string, way int")
    limbs = df.select("g", "way", *[c.alias(f"l{i}") for i, c in enumerate(wallets.limbs(F.col("x")))])
    sums = limbs.groupBy("g").agg(F.array(*[F.sum(F.col(f"l{i}") * F.col("way")) for i in range(8)]).alias("s"))
    got = {r["g"]: (r["sign"], r["digits"]) for r in sums.select("g", wallets.sign(F.col("s")).alias("sign"), wallets.digits(F.col("s")).alias("digits")).collect()}
    want = {}
    for g, x, way in groups:
        want[g] = want.get(g, 0) + way * int(x, 16)
    assert got == {g: ((v > 0) - (v < 0), str(abs(v))) for g, v in want.items()}
    assert max(abs(v) for v in want.values()) > 2**128
    odd = spark.createDataFrame([("0x",), ("0xg",), ("12",), (None,), ("0x" + "0" * 70 + "1",), ("0x1" + "0" * 64,)], "x string")
    assert [r[0] for r in odd.select(F.array(*wallets.limbs(F.col("x")))[0]).collect()] == [None, None, None, None, 1, None]


def test_sums_are_carried_once(spark):
    """However often a carried sum is mentioned, it is computed once a row, and not again for each limb; a number below 2^126 needs no chunks."""
    df = spark.createDataFrame([([5, 0, 0, 0, 0, 0, 0, 0],), ([-1, 0, 0, (1 << 30) - 1, 0, 0, 0, 0],), ([0, 0, 0, 1 << 30, 0, 0, 0, 0],), ([0, 0, 0, 0, -(1 << 31), 0, 0, 0],)], "s array<long>")
    count = lambda c: df.select(c.alias("x"))._jdf.queryExecution().analyzed().toString().count("aggregate(")
    assert count(wallets.sign(F.col("s"))) == 1 and count(wallets.digits(F.col("s"))) == 4
    want = [5, ((1 << 30) - 1 << 96) - 1, 1 << 126, 1 << 159]
    assert [r[0] for r in df.select(wallets.digits(F.col("s"))).collect()] == [str(x) for x in want]


def test_significant_digits(spark):
    rng = random.Random(2)
    rows = [("0", 18), ("1", 0), ("1", 18), ("9999999999", 3), ("99999999995", 3), ("99999999994", 3), ("100", 2), *((str(rng.getrandbits(rng.randint(1, 250))), rng.randint(0, 30)) for _ in range(200))]
    got = [r[0] for r in spark.createDataFrame(rows, "raw string, decimals int").select(wallets.scaled(F.col("raw"), F.col("decimals"))).collect()]
    context = Context(prec=10, rounding=ROUND_HALF_UP)
    plain = lambda d: format(d, "f").rstrip("0").rstrip(".") if "." in format(d, "f") else format(d, "f")
    assert got == [plain(context.create_decimal(Decimal(raw).scaleb(-d, Context(prec=200)))) for raw, d in rows]


ME, POOL, WETH, TOKEN = "0x" + "Ab" * 20, "0x" + "cd" * 20, "0x" + "11" * 20, "0x" + "22" * 20


def topic(address):
    return "0x" + "0" * 24 + address[2:]


def log(token, giver, taker, amount, name=wallets.TRANSFER):
    return {"address": token.upper().replace("0X", "0x"), "topics": [name, topic(giver), topic(taker)], "data": hex(amount) if isinstance(amount, int) else amount}


def test_evm_swaps(spark):
    big = 2**200 + 7
    receipts = {
        "buy": {"status": "0x1", "logs": [log(WETH, ME, POOL, 5), log(TOKEN, POOL, ME, big), log(TOKEN, ME, POOL, 7), log(TOKEN, POOL, POOL, 99)]},
        "sell": {"logs": [log(TOKEN, ME, POOL, 10**30), log(WETH, POOL, ME, 3)]},
        "failed": {"status": "0x0", "logs": [log(WETH, ME, POOL, 5), log(TOKEN, POOL, ME, 1)]},
        "same way": {"logs": [log(WETH, POOL, ME, 5), log(TOKEN, POOL, ME, 1)]},
        "cancelled": {"logs": [log(WETH, ME, POOL, 5), log(WETH, POOL, ME, 5), log(TOKEN, POOL, ME, 1)]},
        "to oneself": {"logs": [log(WETH, ME, ME, 5), log(TOKEN, POOL, ME, 1)]},
        "zero token": {"logs": [log(WETH, ME, POOL, 5), log(wallets.ZERO, POOL, ME, 1)]},
        "other events": {"logs": [log(WETH, ME, POOL, 5, "0x1"), log(TOKEN, POOL, ME, 1), {"topics": None}, {"address": WETH, "topics": [wallets.TRANSFER], "data": "0x1"}, log(WETH, ME, POOL, "soon")]},
    }
    rows = [(k, ME, json.dumps(v)) for k, v in receipts.items()] + [("text", ME, "not json"), ("null", ME, None), ("nobody", None, json.dumps(receipts["buy"]))]
    got = wallets.swaps(wallets.evm_deltas(spark.createDataFrame(rows, "tx string, wallet string, receipt string")), [WETH]).collect()
    assert sorted((r["tx"], r["side"], r["token"], r["token_raw"], r["quote"], r["quote_raw"]) for r in got) == [("buy", "buy", TOKEN, str(big - 7), WETH, "5"), ("sell", "sell", TOKEN, str(10**30), WETH, "3")]


def test_solana_swaps(spark):
    held = lambda mint, amount, owner="me", decimals=6: {"owner": owner, "mint": mint, "uiTokenAmount": {"amount": amount, "decimals": decimals}}
    keys = lambda *names: {"message": {"accountKeys": list(names)}}
    bodies = {
        "fee payer": {"meta": {"err": None, "fee": 5000, "preTokenBalances": [], "postTokenBalances": [held("tok", "1234567890123")], "preBalances": [2_000_005_000, 7], "postBalances": [1_000_000_000, 7]}, "transaction": keys("me", "x")},
        "fee only": {"meta": {"fee": 5000, "preTokenBalances": [], "postTokenBalances": [held("tok", "1")], "preBalances": [10_000], "postBalances": [5_000]}, "transaction": keys("me")},
        "sold": {"meta": {"preTokenBalances": [held("tok", "50"), held("usd", "1"), held("tok", "9", "other")], "postTokenBalances": [held("usd", "3000001")], "preBalances": [1, 1], "postBalances": [1, 1]}, "transaction": keys("x", "me")},
        "failed": {"meta": {"err": "no", "preTokenBalances": [], "postTokenBalances": [held("tok", "1")], "preBalances": [5], "postBalances": [1]}, "transaction": keys("me")},
        "bad amounts": {"meta": {"preTokenBalances": [held("usd", "x"), held("usd", None)], "postTokenBalances": [held("tok", "1")]}, "transaction": keys("me")},
    }
    deltas = wallets.solana_deltas(spark.createDataFrame([(k, "me", json.dumps(v)) for k, v in bodies.items()] + [("none", "me", None)], "tx string, wallet string, body string"))
    found = wallets.swaps(deltas, ["usd", "native"])
    got = found.select("tx", "side", "token", wallets.scaled(F.col("token_raw"), F.col("token_decimals")).alias("amount"), "quote", wallets.scaled(F.col("quote_raw"), F.col("quote_decimals")).alias("paid")).collect()
    assert sorted(map(tuple, got)) == [("fee payer", "buy", "tok", "1234567.89", "native", "1"), ("sold", "sell", "tok", "0.00005", "usd", "3")]


@pytest.mark.parametrize("f", [wallets.evm_deltas, wallets.solana_deltas])
def test_no_rows(spark, f):
    assert wallets.swaps(f(spark.createDataFrame([], "tx string, wallet string, receipt string, body string")), ["a"]).count() == 0
