"""Security verdicts of tokens from a provider's JSON, kept as VARIANT: flags that are true, false or unknown, taxes, holders.

What is absent or malformed is unknown, never safe: a finding rejects, else a gap leaves the verdict
unknown, and only a complete answer without findings passes.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftline.operators import normalize

# The provider's names of flags, and the reasons that users see.
SOLANA_STATUS = "mintable freezable closable transfer_fee_upgradable default_account_state_upgradable balance_mutable_authority transfer_hook_upgradable".split()
EVM_FLAGS = "is_honeypot cannot_buy cannot_sell_all is_proxy is_mintable can_take_back_ownership owner_change_balance hidden_owner selfdestruct external_call is_blacklisted is_whitelisted slippage_modifiable personal_slippage_modifiable transfer_pausable".split()
EVM_NESTED = "honeypot_with_same_creator fake_token malicious_address".split()
B20_STATUS = "mintable transfer_pausable owner_change_balance metadata_modifiable blacklist whitelist cannot_sell cannot_buy".split()
CREATOR_FLAGS = (
    "honeypot_related_address phishing_activities blackmail_activities stealing_attack fake_kyc malicious_mining_activities darkweb_transactions cybercrime money_laundering financial_crime blacklist_doubt gas_abuse reinit fake_standard_interface fake_token".split()
)
BURN = "^0x(0{40}|0{36}dead)$"
NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"
MALICIOUS = r'(?<!\\)"malicious_address":("1"|1(\.0+)?|true)(?=[,}\]])'


@dataclass(frozen=True)
class Limits:
    """Largest tax, share of one holder and share of ten."""

    tax: float = 0.1
    holder: float = 0.2
    ten: float = 0.6


def part(value: Column, path: str) -> Column:
    """What is at a path; null if nothing is."""
    return F.try_variant_get(value, path, "variant")


def kind(value: Column) -> Column:
    """OBJECT, ARRAY, STRING, BOOLEAN, VOID or a number's type; null if there is nothing."""
    return F.regexp_extract(F.schema_of_variant(value), "^[A-Z]+", 0)


def text(value: Column) -> Column:
    return F.try_variant_get(value, "$", "string")


def scalars(values: Column) -> Column:
    """Text (t) and kind (k) of each variant of an array."""
    return F.transform(values, lambda v: F.struct(text(v).alias("t"), kind(v).alias("k")))


def flags(values: Column) -> Column:
    """Of each variant of an array: true of 1, "1" and true, false of 0, "0" and false, else null."""
    given = F.transform(scalars(values), lambda s: F.struct(s["t"].alias("t"), s["k"].alias("k"), F.when(~s["k"].isin("STRING", "BOOLEAN"), s["t"].try_cast("double")).alias("n")))
    yes = lambda s: ((s["k"] == "STRING") & (s["t"] == "1")) | ((s["k"] == "BOOLEAN") & (s["t"] == "true")) | (s["n"] == 1)
    no = lambda s: ((s["k"] == "STRING") & (s["t"] == "0")) | ((s["k"] == "BOOLEAN") & (s["t"] == "false")) | (s["n"] == 0)
    return F.transform(given, lambda s: F.when(yes(s), F.lit(True)).when(no(s), F.lit(False)))


def numbers(values: Column) -> Column:
    """Of each variant of an array: a finite number of zero or more, as a number or its text; else null."""
    read = F.transform(scalars(values), lambda s: F.when((s["k"] != "BOOLEAN") & s["t"].rlike(NUMBER), F.trim(s["t"]).try_cast("double")))
    return F.transform(read, lambda n: F.when((n >= 0) & (n < F.lit(float("inf"))), n))


def number(value: Column) -> Column:
    return F.get(numbers(F.array(value)), F.lit(0))


def keys(value: Column) -> Column:
    """How many keys an object has; 0 of anything else."""
    return F.coalesce(F.size(F.map_keys(F.try_variant_get(value, "$", "map<string,variant>"))), F.lit(0)) * F.when(kind(value) == "OBJECT", 1).otherwise(0)


def elements(value: Column) -> Column:
    return F.when(kind(value) == "ARRAY", F.try_variant_get(value, "$", "array<variant>"))


Found = list[tuple[str, Column]]


class Reading:
    """What one kind of chain reads of an answer, each value computed once a row however often checks name it.

    A check gets a reference to a column of `columns`, which a projection below the checks has.
    """

    def __init__(self) -> None:
        self.flag_values: list[Column] = []
        self.number_values: list[Column] = []
        self.others: list[Column] = []

    def flag(self, value: Column) -> Column:
        self.flag_values.append(value)
        return F.get("__flags", F.lit(len(self.flag_values) - 1))

    def number(self, value: Column) -> Column:
        self.number_values.append(value)
        return F.get("__numbers", F.lit(len(self.number_values) - 1))

    def boolean(self, value: Column) -> Column:
        self.others.append(value)
        return F.get("__booleans", F.lit(len(self.others) - 1))

    def columns(self) -> dict[str, Column]:
        return {"__flags": flags(F.array(*self.flag_values)), "__numbers": numbers(F.array(*self.number_values)), "__booleans": F.array(*self.others)}


def demanded(name: str, f: Column) -> tuple[Found, Found]:
    """A flag that must be known and false: a finding if true, a gap if unknown."""
    return [(name, f)], [(name, f.isNull())]


def taxed(name: str, n: Column, limits: Limits) -> tuple[Found, Found]:
    return [(name, n > limits.tax)], [(name, n.isNull())]


def joined(*sides: tuple[Found, Found]) -> tuple[Found, Found]:
    return [x for a, _ in sides for x in a], [x for _, b in sides for x in b]


def solana(read: Reading, data: Column, limits: Limits) -> tuple[Found, Found, Column, Column]:
    state = read.number(part(data, "$.default_account_state"))
    sides = [demanded(k, read.flag(part(data, f"$.{k}.status"))) for k in SOLANA_STATUS] + [demanded("non_transferable", read.flag(part(data, "$.non_transferable")))]
    sides.append(([("Accounts not transferable", state != 1)], [("default_account_state", state.isNull())]))
    fields = [part(data, "$.creators"), part(data, "$.creator")]
    creators = F.concat(*[F.coalesce(elements(f), F.array().cast("array<variant>")) for f in fields])
    odd = (F.size(creators) == 0) | (F.coalesce(kind(fields[0]) != "ARRAY", F.lit(False))) | (F.coalesce(kind(fields[1]) != "ARRAY", F.lit(False)))
    of = flags(F.transform(creators, lambda c: part(c, "$.malicious_address")))
    sides.append(([], [("creator", odd)]))
    sides.append(([("creator.malicious_address", F.exists(of, lambda x: x))], [("creator.malicious_address", F.exists(of, lambda x: x.isNull()))]))
    hook = part(data, "$.transfer_hook")
    some = F.when(kind(hook) == "ARRAY", F.size(elements(hook))).when(kind(hook) == "OBJECT", keys(hook))
    sides.append(([("Transfer hook can block selling", read.boolean(some > 0))], [("transfer_hook", read.boolean(some.isNull()))]))
    fee = part(data, "$.transfer_fee")
    fees = read.boolean(kind(fee) == "OBJECT")
    charged = fees & read.boolean(keys(fee) > 0)
    now, later = (read.number(part(fee, f"$.{w}_fee_rate.fee_rate")) / 10_000 for w in ("current", "scheduled"))
    planned = charged & read.boolean(F.coalesce(~kind(part(fee, "$.scheduled_fee_rate")).isin("VOID"), F.lit(False)) & ~F.coalesce(text(part(fee, "$.scheduled_fee_rate")).isin("", "0", "false"), F.lit(False)))
    sides.append(([], [("transfer_fee", ~F.coalesce(fees, F.lit(False)))]))
    sides.append(([("transfer_fee.current", charged & (now > limits.tax))], [("transfer_fee.current", charged & now.isNull())]))
    sides.append(([("transfer_fee.scheduled", planned & (later > limits.tax))], [("transfer_fee.scheduled", planned & later.isNull())]))
    tax = F.when(charged, now).when(fees, F.lit(0.0))
    return *joined(*sides), tax, tax


def evm(read: Reading, data: Column, creator: Column, pool: Column, limits: Limits) -> tuple[Found, Found, Column, Column]:
    share = read.number(part(data, "$.creator_percent"))
    sides: list[tuple[Found, Found]] = [([], [("Verified contract source", ~F.coalesce(read.flag(part(data, "$.is_open_source")), F.lit(False)))]), ([("Dangerous creator concentration", share > limits.holder)], [])]
    sides += [demanded(k, read.flag(part(data, f"$.{k}"))) for k in EVM_FLAGS]
    for k in EVM_NESTED:
        v = part(data, f"$.{k}")
        inner = F.when(read.boolean(F.coalesce(kind(part(v, "$.value")), F.lit("VOID")) != "VOID"), read.flag(part(v, "$.value"))).otherwise(read.flag(part(v, "$.status")))
        sides.append(([(k, F.when(read.boolean(keys(v) > 0), inner).otherwise(read.flag(v)))], []))
    b20 = part(data, "$.b20_token")
    is_b20 = read.flag(part(b20, "$.is_b20"))
    sides.append(([], [("B20 classification", (keys(b20) > 0) & is_b20.isNull())]))
    for k in B20_STATUS:
        f = read.flag(part(b20, f"$.b20_info.{k}.status"))
        sides.append(([(f"B20 {k}", is_b20 & f)], [(f"B20 {k}", is_b20 & f.isNull())]))
    known = read.boolean(F.coalesce(number(part(creator, "$.code")) == 1, F.lit(False)) & (keys(part(creator, "$.result")) > 0))
    sides.append(([], [("Creator address security", ~known)]))
    for k in CREATOR_FLAGS:
        f = read.flag(part(creator, f"$.result.{k}"))
        sides.append(([(f"Creator {k}", known & f)], [(f"Creator {k}", known & f.isNull())]))
    sides.append(([("Creator deployed malicious contracts", known & (read.number(part(creator, "$.result.number_of_malicious_contracts_created")) > 0))], []))
    buy, sell = read.number(part(data, "$.buy_tax")), read.number(part(data, "$.sell_tax"))
    sides += [taxed("buy_tax", buy, limits), taxed("sell_tax", sell, limits)]
    own = F.get(F.filter(elements(part(data, "$.dex")), lambda x: (kind(part(x, "$.pair")) == "STRING") & (F.lower(text(part(x, "$.pair"))) == F.lower(pool))), F.lit(0))
    fee = F.coalesce(read.number(part(own, "$.pool_fee")), F.lit(0.0))
    sides.append(([("buy_tax + pool_fee", (fee > 0) & (buy + fee > limits.tax)), ("sell_tax + pool_fee", (fee > 0) & (sell + fee > limits.tax))], []))
    return *joined(*sides), buy + fee, sell + fee


def shares(data: Column, is_solana: Column, pool: Column) -> tuple[Column, Column]:
    """Whether ten or more holders are listed; the share of each, null if unknown, on EVM chains without the pool and burnt tokens."""
    listed = elements(part(data, "$.holders"))
    who = lambda h: F.coalesce(F.lower(F.when(kind(part(h, "$.address")) == "STRING", text(part(h, "$.address")))), F.lit(""))
    each = F.transform(listed, lambda h: F.struct(who(h).alias("who"), part(h, "$.percent").alias("percent")))
    counted = F.filter(each, lambda x: is_solana | ~(F.coalesce(x["who"] == F.lower(pool), F.lit(False)) | x["who"].rlike(BURN)))
    return F.coalesce(F.size(listed) >= 10, F.lit(False)), F.transform(numbers(F.transform(counted, lambda x: x["percent"])), lambda n: F.when(n <= 1, n))


def holders(enough: Column, found: Column, limits: Limits) -> tuple[Found, Found]:
    """Shares of the largest holder and of the ten largest, of those that `shares` found."""
    fine = F.sort_array(F.array_compact(found), asc=False)
    ten = F.aggregate(F.slice(fine, 1, 10), F.lit(0.0), lambda a, x: a + x)
    return [("Dangerous holder concentration", enough & ((F.coalesce(F.get(fine, F.lit(0)), F.lit(0.0)) > limits.holder) | (ten > limits.ten)))], [("Top-ten holder concentration", ~enough), ("Holder percentage", enough & F.exists(found, lambda x: x.isNull()))]


def checked(rows: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Adds status (REJECT, UNKNOWN or PASS), reasons, buy_tax and sell_tax to rows of chain, token, payload (JSON text) and pool.

    The token's own entry is found by its canonical address. Reasons are findings, then gaps as
    "Unknown: ...", each once, in a fixed order. Text that is no JSON, a null or an answer without
    the token is UNKNOWN. Row by row, without an exchange.
    """
    entries = F.map_entries(F.try_variant_get(F.col("__body"), "$.result", "map<string,variant>"))
    own = F.get(F.filter(entries, lambda e: normalize.address(F.col("chain"), e["key"]) == normalize.address(F.col("chain"), F.col("token"))), F.lit(0))["value"]
    answer = rows.select("*", F.try_parse_json("payload").alias("__body")).select("*", own.alias("__data"))
    answer = answer.withColumn("__answered", F.coalesce(number(part(F.col("__body"), "$.code")) == 1, F.lit(False)) & F.col("__data").isNotNull())
    data, creator, on_solana = F.col("__data"), part(F.col("__body"), "$.creatorSecurity"), F.col("chain") == "solana"
    either = lambda a, b: F.when(on_solana, a).otherwise(b)
    readings = Reading(), Reading()
    sides = solana(readings[0], data, limits), evm(readings[1], data, creator, F.col("pool"), limits)
    values = {name: either(a, b) for (name, a), b in zip(readings[0].columns().items(), readings[1].columns().values(), strict=True)}
    enough, found = shares(data, on_solana, F.col("pool"))
    values |= {"__bad": F.to_json(data).rlike(MALICIOUS), "__enough": enough, "__shares": found}
    told = lambda checks: F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in checks]))
    held_r, held_m = holders(F.col("__enough"), F.col("__shares"), limits)
    verdict = {"__r": either(*(told(x[0]) for x in sides)), "__m": either(*(told(x[1]) for x in sides)), "__buy": either(*(x[2] for x in sides)), "__sell": either(*(x[3] for x in sides)), "__held_r": told(held_r), "__held_m": told(held_m)}
    read = answer.select("*", *[c.alias(n) for n, c in values.items()]).select("*", *[c.alias(n) for n, c in verdict.items()])
    risky = F.concat(F.when(F.col("__bad"), F.array(F.lit("Malicious authority or creator"))).otherwise(F.array().cast("array<string>")), "__r", "__held_r")
    missing = F.transform(F.concat("__m", "__held_m"), lambda x: F.concat(F.lit("Unknown: "), x))
    status = F.when(~F.col("__answered"), "UNKNOWN").when(F.size(risky) > 0, "REJECT").when(F.size(missing) > 0, "UNKNOWN").otherwise("PASS")
    reasons = F.when(~F.col("__answered"), F.array(F.lit("Security response unavailable or token missing"))).otherwise(F.array_distinct(F.concat(risky, missing)))
    taxes = [F.when(F.col("__answered"), F.col(f"__{w}")).alias(f"{w}_tax") for w in ("buy", "sell")]
    return read.select(*rows.columns, status.alias("status"), reasons.alias("reasons"), *taxes)
