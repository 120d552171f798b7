"""Paper accounts: each reason and each sale by hand, money that adds up, and a stream that equals the table."""

import random
from decimal import Decimal as D

import pytest

from driftline.operators.folds import HOUR
from driftline.operators.paper import REASONS, Account, Policy, replay
from driftline.plans import states

MINUTE = 60_000
NOON = 1_704_135_600_000  # 1 January 2024, 12:00 in Phoenix


def run(policy, rows, state=None):
    fold, out = Account(policy), []
    for i, row in enumerate(rows):
        row = {"id": i, "token": None, "pool": "p", "price": None, "quote_at": row["at"], "signal_at": None} | row
        state, more = fold.step(state, row)
        out += more
    return state, [(o[2], next((k for k, v in REASONS.items() if v == o[3]), None), *o[5:]) for o in out]


def quote(at, token, price, **more):
    return {"at": NOON + at, "kind": "quote", "token": token, "price": price} | more


def signal(at, token, price=1.0, **more):
    return {"at": NOON + at, "kind": "signal", "token": token, "price": price, "signal_at": NOON + at} | more


def kinds(out):
    return [x[:2] for x in out]


def test_profit_then_trail():
    state, out = run(Policy(), [signal(0, "a"), quote(1, "a", 1.49), quote(2, "a", 1.5), quote(3, "a", 1.6), quote(4, "a", 1.13), quote(5, "a", 1.12), quote(6, "a", 0.1)])
    assert out == [
        ("enter", None, D(10), D(1), D(-10), D(0), D(90), D(100)),
        ("profit", None, D(5), D("1.5"), D("7.5"), D("2.5"), D("97.5"), D(105)),
        ("trail", None, D(5), D("1.12"), D("5.6"), D("0.6"), D("103.1"), D("103.1")),
    ]
    assert (state[2], state[3]) == ("103.10", "3.10") or (D(state[2]), D(state[3])) == (D("103.1"), D("3.1"))


def test_stop_and_costs():
    p = Policy(fee=D("0.01"), slip=D("0.02"), network=D("0.5"))
    _, out = run(p, [signal(0, "a", 2.0), quote(1, "a", 1.3), quote(2, "a", 1.1)])
    held = (D("9.5") / D("1.01") / D("2.04")).quantize(D("1e-18"))
    assert kinds(out) == [("enter", None), ("stop", None)] and abs(out[0][2] - held) < D("1e-17") and out[0][3] == D("2.04")
    assert abs(out[1][4] - (held * D("1.1") * D("0.98") * D("0.99") - D("0.5"))) < D("1e-16") and out[1][5] == out[1][4] - 10
    assert run(Policy(sell=D(1)), [signal(0, "a"), quote(1, "a", 1.5)])[0][8] == []


def test_each_reason_and_their_order():
    p = Policy(most_positions=2, most_entries=3)
    first = lambda rows, policy=p: kinds(run(policy, rows)[1])[-1]
    assert first([{"at": NOON, "kind": "pause"}, signal(1, "a")]) == ("refuse", "paused")
    assert first([{"at": NOON, "kind": "pause"}, {"at": NOON, "kind": "resume"}, signal(1, "a")]) == ("enter", None)
    for sent in (None, NOON - 1, NOON + 2, NOON + 2 - 5 * MINUTE - 1):
        assert first([quote(0, "z", 1.0), signal(1, "a", signal_at=sent)]) == ("refuse", "signal")
    for bad in ({"price": None}, {"price": 0.0}, {"price": float("nan")}, {"price": float("inf")}, {"quote_at": None}, {"quote_at": NOON + 2}, {"quote_at": NOON - MINUTE}, {"pool": None}):
        assert first([signal(1, "a", **bad)]) == ("refuse", "quote"), bad
    assert first([signal(0, "a"), signal(MINUTE + 1, "b")]) == ("refuse", "marks")
    assert first([signal(0, "a"), quote(MINUTE, "a", 1.0), signal(MINUTE + 1, "b")]) == ("enter", None)
    assert first([signal(0, "a"), quote(MINUTE, "a", 1.0, pool="q"), signal(MINUTE + 1, "b")]) == ("refuse", "marks")
    assert first([signal(0, "a"), signal(1, "a")]) == ("refuse", "token")
    assert first([signal(0, "a"), quote(1, "a", 0.4), signal(24 * HOUR, "a")]) == ("refuse", "token")
    assert first([signal(0, "a"), quote(1, "a", 0.4), signal(24 * HOUR + 1, "a")]) == ("enter", None)
    assert first([signal(0, "a"), signal(1, "b"), signal(2, "c")]) == ("refuse", "positions")
    sold = [signal(0, "a"), quote(1, "a", 0.4), signal(2, "b"), quote(3, "b", 0.4), signal(4, "c"), quote(5, "c", 0.4)]
    assert first([*sold, signal(6, "d")]) == ("refuse", "entries")
    assert first([*sold, signal(12 * HOUR, "d")]) == ("enter", None)  # midnight there
    assert first([*sold, signal(12 * HOUR - 1, "d")]) == ("refuse", "entries")
    assert first(sold[:4] + [signal(6, "d")], Policy(daily_loss=D(12))) == ("refuse", "loss")
    assert first([signal(0, "a"), signal(1, "b")], Policy(bankroll=D(15), daily_loss=D(15))) == ("refuse", "cash")
    assert first([signal(0, "a")], Policy(network=D(3), daily_loss=D(6))) == ("refuse", "costs")
    assert first([signal(0, "a")], Policy(network=D(3), daily_loss=D("6.01"))) == ("enter", None)


def test_another_policy_leaves_the_state_alone():
    state, _ = run(Policy(), [signal(0, "a")])
    after, out = run(Policy(trail=D("0.2")), [quote(1, "a", 0.1), signal(2, "b"), {"at": NOON + 3, "kind": "pause"}], state)
    assert after == state and kinds(out) == [("refuse", "policy")] * 2


def test_money_adds_up():
    rng = random.Random(3)
    p = Policy(fee=D("0.003"), slip=D("0.001"), network=D("0.05"), fresh=HOUR, daily_loss=D(90), most_entries=9, cooldown=HOUR)
    rows, price = [], dict.fromkeys("abcde", 1.0)
    for i in range(3000):
        token = rng.choice("abcde")
        price[token] *= rng.choice((0.8, 0.97, 1.05, 1.2))
        rows.append((quote if rng.random() < 0.8 else signal)(i * 4 * MINUTE, token, round(price[token], 6) or 1.0))
    state, out = run(p, rows)
    assert {x[0] for x in out} == {"enter", "refuse", "stop", "trail", "profit"}
    spent = sum(x[4] for x in out if x[4] is not None)
    assert abs(D(state[2]) - (p.bankroll + spent)) < D("1e-12")
    assert abs(D(state[3]) - sum(x[5] for x in out if x[5] is not None)) < D("1e-12")
    left = sum(map(D, state[11]), D(0))
    assert abs(D(state[2]) + left - p.bankroll - D(state[3])) < D("1e-12") and len(state[8]) <= p.most_positions


def test_invalid_policies():
    for bad in ({"order": D(200)}, {"network": D(10)}, {"stop": D(1)}, {"daily_loss": D(101)}, {"most_positions": 0}):
        with pytest.raises(ValueError, match="invalid"):
            Policy(**bad)


def test_accounts_over_tables_and_streams(spark):
    sf = "/root/testdata/sf0.001"
    batch = states.paper_account(spark, sf)
    newest = states.events(spark, sf).agg({"at": "max"}).first()[0]
    want = sorted(map(str, batch.where(f"at < {newest}").collect()))
    assert want and sorted(map(str, states.stream_paper_account(spark, sf).select(*batch.columns).collect())) == want
    none = states.account_rows(states.events(spark, sf).limit(0))
    assert replay(none, ["user_id"]).count() == 0
