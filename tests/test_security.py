"""Security verdicts: every family of flags, the order of verdicts, nested keys, holders, taxes."""

import copy
import json

import pytest

from driftline.operators import security

EVM, SOL, POOL = "0x" + "aB" * 20, "So" + "1" * 40, "0x" + "cc" * 20


def evm():
    holders = [{"address": f"0x{i:040x}", "percent": "0.01"} for i in range(1, 11)]
    return {"is_open_source": "1", "creator_percent": "0.01", **dict.fromkeys(security.EVM_FLAGS, "0"), "buy_tax": "0.01", "sell_tax": 0.02, "holders": holders}, dict.fromkeys(security.CREATOR_FLAGS, "0")


def sol():
    return {
        **{k: {"status": "0"} for k in security.SOLANA_STATUS}, "non_transferable": "0", "default_account_state": "1", "creators": [{"malicious_address": 0}], "transfer_hook": [], "transfer_fee": {},
        "holders": [{"account": str(i), "percent": 0.02} for i in range(10)],
    }


def check(spark, cases):
    rows = [(i, chain, token, p if p is None or isinstance(p, str) else json.dumps(p), POOL) for i, (chain, token, p) in enumerate(cases)]
    got = security.checked(spark.createDataFrame(rows, "n int, chain string, token string, payload string, pool string")).orderBy("n").collect()
    return [(r["status"], r["reasons"], r["buy_tax"], r["sell_tax"]) for r in got]


def evm_case(change=lambda data, creator: None, **more):
    data, creator = copy.deepcopy(evm())
    change(data, creator)
    return "base", EVM, {"code": 1, "result": {EVM.lower(): data}, "creatorSecurity": {"code": "1", "result": creator}} | more


def sol_case(change=lambda data: None):
    data = copy.deepcopy(sol())
    change(data)
    return "solana", SOL, {"code": 1, "result": {SOL: data}}


def test_answers_that_pass_or_are_missing(spark):
    cases = [evm_case(), sol_case(), ("base", EVM, None), ("base", EVM, "no json"), ("base", EVM, {"code": 2, "result": {EVM: evm()[0]}}), ("base", EVM, {"code": 1, "result": {POOL: evm()[0]}}), ("base", EVM, {"code": 1, "result": []})]
    got = check(spark, cases)
    assert got[0] == ("PASS", [], 0.01, 0.02) and got[1] == ("PASS", [], 0.0, 0.0)
    assert all(g == ("UNKNOWN", ["Security response unavailable or token missing"], None, None) for g in got[2:])


@pytest.mark.parametrize("value", [1, "1", True])
def test_every_evm_flag(spark, value):
    cases, want = [], []
    for k in security.EVM_FLAGS:
        cases.append(evm_case(lambda d, c, k=k: d.update({k: value})))
        want.append([k])
    for k in security.CREATOR_FLAGS:
        cases.append(evm_case(lambda d, c, k=k: c.update({k: value})))
        want.append([f"Creator {k}"])
    for k in security.EVM_NESTED:
        cases += [evm_case(lambda d, c, k=k: d.update({k: value})), evm_case(lambda d, c, k=k: d.update({k: {"value": value}})), evm_case(lambda d, c, k=k: d.update({k: {"value": None, "status": value}}))]
        want += [["Malicious authority or creator"] * (k == "malicious_address") + [k], [k], [k]]
    got = check(spark, cases)
    assert [g[:2] for g in got] == [("REJECT", w) for w in want]


def test_unknown_flags_and_their_order_after_findings(spark):
    info = {k: {"status": 0} for k in security.B20_STATUS}
    cases = [
        evm_case(lambda d, c: d.pop("is_proxy")), evm_case(lambda d, c: (d.update(is_proxy="2", hidden_owner=1), c.pop("reinit"))), evm_case(lambda d, c: d.update(is_open_source=0)), evm_case(creatorSecurity=None),
        evm_case(lambda d, c: d.update(b20_token={"is_b20": 1, "b20_info": info | {"blacklist": {"status": 1}, "cannot_buy": {}}})), evm_case(lambda d, c: d.update(b20_token={"other": 1})), evm_case(lambda d, c: d.update(b20_token={"is_b20": "0"})),
        evm_case(lambda d, c: d.update(deep=[{"x": {"malicious_address": "1"}}])), evm_case(lambda d, c: d.update(note='"malicious_address":1,')), evm_case(lambda d, c: c.update(number_of_malicious_contracts_created="2")), evm_case(lambda d, c: d.update(creator_percent=0.3)),
    ]
    got = [g[:2] for g in check(spark, cases)]
    assert got == [
        ("UNKNOWN", ["Unknown: is_proxy"]), ("REJECT", ["hidden_owner", "Unknown: is_proxy", "Unknown: Creator reinit"]), ("UNKNOWN", ["Unknown: Verified contract source"]), ("UNKNOWN", ["Unknown: Creator address security"]),
        ("REJECT", ["B20 blacklist", "Unknown: B20 cannot_buy"]), ("UNKNOWN", ["Unknown: B20 classification"]), ("PASS", []),
        ("REJECT", ["Malicious authority or creator"]), ("PASS", []), ("REJECT", ["Creator deployed malicious contracts"]), ("REJECT", ["Dangerous creator concentration"]),
    ]


def test_taxes_and_holders(spark):
    whale = lambda a, p: lambda d, c: d["holders"].append({"address": a, "percent": p})
    cases = [
        evm_case(lambda d, c: d.update(buy_tax="0.5")), evm_case(lambda d, c: d.update(sell_tax="")), evm_case(lambda d, c: d.update(dex=[{"pair": POOL.upper().replace("0X", "0x"), "pool_fee": "0.095"}])), evm_case(lambda d, c: d.update(dex=[{"pair": EVM, "pool_fee": 1}])),
        evm_case(whale(POOL, 0.9)), evm_case(whale("0x" + "0" * 36 + "dEaD", 0.9)), evm_case(whale("0x" + "9" * 40, 0.3)), evm_case(whale("0x" + "9" * 40, "1.5")), evm_case(lambda d, c: d["holders"].pop()), evm_case(lambda d, c: [h.update(percent=0.07) for h in d["holders"]]),
    ]
    got = check(spark, cases)
    assert [g[:2] for g in got] == [
        ("REJECT", ["buy_tax"]), ("UNKNOWN", ["Unknown: sell_tax"]), ("REJECT", ["buy_tax + pool_fee", "sell_tax + pool_fee"]), ("PASS", []),
        ("PASS", []), ("PASS", []), ("REJECT", ["Dangerous holder concentration"]), ("UNKNOWN", ["Unknown: Holder percentage"]), ("UNKNOWN", ["Unknown: Top-ten holder concentration"]), ("REJECT", ["Dangerous holder concentration"]),
    ]
    assert got[2][2:] == pytest.approx((0.105, 0.115)) and got[1][3] is None


def test_solana(spark):
    cases = [sol_case(lambda d, k=k: d.update({k: {"status": "1"}})) for k in security.SOLANA_STATUS]
    cases += [
        sol_case(lambda d: d.update(non_transferable="1")), sol_case(lambda d: d.update(default_account_state=2)), sol_case(lambda d: d.update(creators=[])), sol_case(lambda d: d.update(creator={"malicious_address": 1})),
        sol_case(lambda d: d.update(creators=[{"malicious_address": 0}, {}])), sol_case(lambda d: d.update(transfer_hook=[{"a": 1}])), sol_case(lambda d: d.update(transfer_hook=None)), sol_case(lambda d: d.update(transfer_fee={"current_fee_rate": {"fee_rate": 2000}})),
        sol_case(lambda d: d.update(transfer_fee={"current_fee_rate": {"fee_rate": "100"}, "scheduled_fee_rate": {"fee_rate": 5000}})), sol_case(lambda d: d.update(transfer_fee=[])), sol_case(lambda d: d["holders"][0].update(address=POOL, percent=0.5)),
    ]
    got = check(spark, cases)
    n = len(security.SOLANA_STATUS)
    assert [g[:2] for g in got[:n]] == [("REJECT", [k]) for k in security.SOLANA_STATUS]
    assert [g[:2] for g in got[n:]] == [
        ("REJECT", ["non_transferable"]), ("REJECT", ["Accounts not transferable"]), ("UNKNOWN", ["Unknown: creator"]), ("REJECT", ["Malicious authority or creator", "Unknown: creator"]),
        ("UNKNOWN", ["Unknown: creator.malicious_address"]), ("REJECT", ["Transfer hook can block selling"]), ("UNKNOWN", ["Unknown: transfer_hook"]), ("REJECT", ["transfer_fee.current"]),
        ("REJECT", ["transfer_fee.scheduled"]), ("UNKNOWN", ["Unknown: transfer_fee"]), ("REJECT", ["Dangerous holder concentration"]),
    ]
    assert got[n + 7][2:] == (0.2, 0.2) and got[n + 8][2:] == (0.01, 0.01)


def test_each_value_of_an_answer_is_read_once(spark):
    rows = spark.createDataFrame([(1, "base", EVM, "{}", POOL)], "n int, chain string, token string, payload string, pool string")
    plan = security.checked(rows)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("$.is_proxy,") == 1 and plan.count("variant_get(") < 250, plan.count("variant_get(")
