"""Discovery scans by hand: what is absent, malformed, zero, repeated or old."""

import json

from driftline.operators import discovery

MINT, OTHER, TOKEN, POOL = "M" * 40, "N" * 40, "0x" + "aB" * 20, "0x" + "Cd" * 32


def test_hints(spark):
    body = lambda pre, post, err=None, method="transactionNotification", **more: json.dumps({"method": method, "params": {"result": {"signature": "s1", "transaction": {"meta": {"err": err, "preTokenBalances": pre, "postTokenBalances": post} | more}}}})
    good = body([{"mint": MINT}], [{"mint": MINT}, {"mint": OTHER}, {"mint": 5}, {"mint": "0bad"}, None, "x"])
    rows = [good, body([{"mint": MINT}], [], "failed"), body([{"mint": MINT}], [], False), body([{"mint": MINT}], [], method="other"), body(None, [{"mint": MINT}]), body([], []), "no json", None, good.replace('"err": null, ', ""), good.replace('"s1"', "7")]
    df = spark.createDataFrame([(i, r, "x") for i, r in enumerate(rows)], "at long, payload string, token string")
    assert sorted(map(tuple, discovery.hints(df).collect())) == [("solana", MINT, "s1", 0, "helius"), ("solana", OTHER, "s1", 0, "helius")]
    assert discovery.hints(df.limit(0)).count() == 0


def row(pool=POOL, token=TOKEN, **changes):
    attributes = {"address": pool, "pool_created_at": "2024-01-01T00:00:00Z", "reserve_in_usd": "12.5", "volume_usd": {"m5": 0, "h24": "1e3"}, "transactions": {"m5": {"buys": 3, "sells": "0", "buyers": 1.5}}, "base_token_price_usd": "0"} | changes
    return {"type": "pool", "attributes": attributes, "relationships": {"base_token": {"data": {"type": "token", "id": f"eth_{token}"}}}}


def scan(spark, *answers):
    rows = [("ethereum", f, at, None if a is None else json.dumps(a)) for f, at, a in answers]
    return discovery.listed(spark.createDataFrame(rows, "chain string, feed string, fetched_at long, payload string"), {"ethereum": "eth"}).cache()


NOW = 1_800_000_000_000


def test_pools(spark):
    second = "0x" + "11" * 20
    bad = [row(pool="0x12"), row(token="0x12"), row(pool_created_at="soon"), row(pool_created_at="2099-01-01T00:00:00Z"), row(reserve_in_usd="-1"), row(reserve_in_usd=None), row(volume_usd={}), row(transactions={"m5": {"buys": 1.5, "sells": 1}}), row() | {"type": "token"}, None, "x"]
    meta = {"type": "token", "id": f"eth_{TOKEN}", "attributes": {"address": TOKEN.upper().replace("0X", "0x"), "name": "n" * 120, "symbol": ""}}
    rows = scan(spark, ("new", NOW, {"data": [row(), *bad, row(second)], "included": [meta]}), ("trending", NOW, {"data": [row(reserve_in_usd=7), row(second, base_token_price_usd="2.5")], "included": [meta | {"attributes": {"address": second}}]}), ("trending", NOW - 1, {"data": [row(reserve_in_usd=1)]}))
    found = {r["pool"]: r for r in discovery.pools(rows, ["base", "ethereum"], NOW + 120_000, turn=1).collect()}
    assert set(found) == {POOL.lower(), second} and {r["place"] for r in found.values()} == {0}
    first = found[POOL.lower()]
    assert (first["token"], first["liquidity"], first["volume5m"], first["volume24h"], first["buys5m"], first["sells5m"], first["buyers5m"], first["price"]) == (TOKEN.lower(), 12.5, 0.0, 1000.0, 3, 0, None, None)
    assert (first["name"], first["symbol"], first["created_at"]) == ("n" * 100, "?", 1_704_067_200_000)  # the other feed's row has another token's address
    assert discovery.pools(rows, ["ethereum"], NOW + 120_001).count() == 0
    assert [tuple(r) for r in discovery.health(rows, 2).collect()] == [("ethereum", 2, 2, len(bad) + 2, True)]


def test_last_wins_and_twenty_rows(spark):
    many = [row("0x" + f"{i:040x}") for i in range(30)]
    rows = scan(spark, ("new", NOW, {"data": many}), ("trending", NOW, {"data": [row("0x" + f"{0:040x}", reserve_in_usd=1), row("0x" + f"{0:040x}", reserve_in_usd=2)]}))
    found = {int(r["pool"], 16): r["liquidity"] for r in discovery.pools(rows, ["ethereum"], NOW).collect()}
    assert sorted(found) == list(range(20)) and found[0] == 2.0 and found[1] == 12.5


def test_answers_that_are_none(spark):
    rows = scan(spark, ("new", NOW, None), ("trending", NOW, {"data": "x"}), ("other", NOW, {"data": [row()], "included": {}}))
    assert discovery.pools(rows, ["ethereum"], NOW).count() == 0
    assert [tuple(r) for r in discovery.health(rows, 3).collect()] == [("ethereum", 0, 0, 0, False)]
    assert discovery.pools(rows.limit(0), ["ethereum"], NOW).count() == 0
