"""Swaps of watched wallets from token transfers and balances, with whole numbers of 256 bits on the JVM.

A number is eight limbs of 32 bits, the lowest first. Sums of limbs are sums of numbers, so net
amounts are plain aggregates with partial sums; only results are carried, signed and written out.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LIMBS, BASE, CHUNK = 8, 1 << 32, 1_000_000_000

# The transfer event's topic, the zero address, and the mints that count as money.
TRANSFER = "0xddf252ad1be2c89b69c2b068fc378daa952ba7f163c4a11628f55a4df523b3ef"
ZERO = "0x0000000000000000000000000000000000000000"

RECEIPT = "status string, logs array<struct<address: string, topics: array<string>, data: string>>"
BALANCE = "array<struct<owner: string, mint: string, uiTokenAmount: struct<amount: string, decimals: int>>>"
TRANSACTION = f"meta struct<err: string, fee: double, preTokenBalances: {BALANCE}, postTokenBalances: {BALANCE}, preBalances: array<decimal(38,0)>, postBalances: array<decimal(38,0)>>, transaction struct<message: struct<accountKeys: array<string>>>"


def once(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body(value)` with `value` computed once a row, however often `body` and lambdas in it mention it."""
    return F.transform(F.array(value), body)[0]


def padded(number: Column) -> Column:
    """64 hexadecimal digits of a number such as 0x1f; null if it is none or has more than 256 bits."""
    digits = F.regexp_extract(number, "^0x0*([0-9a-fA-F]{0,64})$", 1)
    fine = number.rlike("^0x[0-9a-fA-F]+$") & number.rlike("^0x0*[0-9a-fA-F]{0,64}$")
    return F.when(fine, F.lpad(digits, 8 * LIMBS, "0"))


def limbs_of(hexed: Column) -> list[Column]:
    """Limbs of 64 hexadecimal digits."""
    return [F.conv(F.substring(hexed, 8 * (LIMBS - 1 - i) + 1, 8), 16, 10).cast("long") for i in range(LIMBS)]


def limbs(number: Column) -> list[Column]:
    """Limbs of a hexadecimal number such as 0x1f; null if it is none or has more than 256 bits."""
    return limbs_of(padded(number))


def carried(sums: Column) -> Column:
    """Limbs within [0, BASE), and one more that holds what is above them: -1 or less for a number below zero."""
    start = F.struct(F.lit(0).cast("long").alias("carry"), F.array().cast("array<long>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        # shifts round down, for sums below zero too
        total = acc["carry"] + x
        return F.struct(F.shiftright(total, 32).alias("carry"), F.concat(acc["out"], F.array(total.bitwiseAND(F.lit(BASE - 1).cast("long")))).alias("out"))

    return F.aggregate(sums, start, step, lambda acc: F.concat(acc["out"], F.array(acc["carry"])))


def sign(sums: Column) -> Column:
    """-1, 0 or 1 of a sum of limbs."""
    return once(carried(sums), lambda c: F.when(F.element_at(c, -1) < 0, -1).when(F.exists(c, lambda x: x != 0), 1).otherwise(0))


def digits(sums: Column) -> Column:
    """Decimal digits of a sum of limbs without its sign, exactly, of any size that 256 bits and the sum of many have."""
    absolute = once(carried(sums), lambda c: F.when(F.element_at(c, -1) < 0, carried(F.transform(sums, lambda x: -x))).otherwise(c))
    return F.when(sums.isNull() | F.exists(sums, lambda x: x.isNull()), F.lit(None)).otherwise(once(absolute, lambda p: F.when(F.exists(F.slice(p, 5, LIMBS), lambda x: x != 0) | (p[3] >= 1 << 30), long_digits(p)).otherwise(short_digits(p))))


def short_digits(positive: Column) -> Column:
    """Digits of limbs that hold less than 2^126, which a decimal holds."""
    two = lambda high, low: high.cast("decimal(20,0)") * F.lit(BASE).cast("decimal(10,0)") + low
    high = (positive[3] * F.lit(BASE).cast("long") + positive[2]).cast("decimal(19,0)")
    return (high * F.lit(str(BASE * BASE)).cast("decimal(20,0)") + two(positive[1], positive[0])).cast("decimal(38,0)").cast("string")


def long_digits(positive: Column) -> Column:
    """Digits of limbs of any size: chunks of nine digits, by which the limbs are shifted in from the highest."""
    chunks = F.array_repeat(F.lit(0).cast("long"), 11)

    def shifted(acc: Column, limb: Column) -> Column:
        start = F.struct(limb.alias("carry"), F.array().cast("array<long>").alias("out"))

        def step(a: Column, chunk: Column) -> Column:
            return once(chunk * BASE + a["carry"], lambda total: F.struct(whole(total).alias("carry"), F.concat(a["out"], F.array(total % CHUNK)).alias("out")))

        return F.aggregate(acc, start, step, lambda a: a["out"])

    found = F.aggregate(F.reverse(positive), chunks, shifted)
    text = F.array_join(F.transform(F.reverse(found), lambda x: F.lpad(x.cast("string"), 9, "0")), "")
    return F.coalesce(F.nullif(F.ltrim(text, F.lit("0")), F.lit("")), F.lit("0"))


def whole(total: Column) -> Column:
    """total div CHUNK."""
    return F.call_function("div", total, F.lit(CHUNK).cast("long"))


def scaled(raw: Column, decimals: Column, places: int = 10) -> Column:
    """Decimal text of raw / 10^decimals with `places` significant digits, halves away from zero, without an exponent or trailing zeros."""
    n = F.length(raw)
    head = F.substring(raw, 1, places).cast("decimal(20,0)") + F.when(F.substring(raw, places + 1, 1) >= "5", 1).otherwise(0)
    rounded = F.when(n > places, F.concat(head.cast("string"), F.repeat(F.lit("0"), n - places))).otherwise(raw)
    padded = F.when(F.length(rounded) > decimals, rounded).otherwise(F.concat(F.repeat(F.lit("0"), decimals + 1 - F.length(rounded)), rounded))
    cut = F.length(padded) - decimals
    fraction = F.regexp_replace(F.substr(padded, cut + 1), "0+$", "")
    return F.concat(F.substr(padded, F.lit(1), cut), F.when(F.length(fraction) > 0, F.concat(F.lit("."), fraction)).otherwise(F.lit("")))


def evm_deltas(receipts: DataFrame) -> DataFrame:
    """tx, wallet, token, place (first log that moves it), sign and raw (digits) of each token's net change in a wallet.

    receipts: tx, wallet, receipt (JSON text). Failed transactions, logs that are no transfers,
    transfers to oneself or of nothing have no part; a receipt that does not parse has no rows.
    """
    parsed = receipts.select("tx", F.lower("wallet").alias("wallet"), F.from_json("receipt", RECEIPT).alias("r")).where("r.logs IS NOT NULL AND coalesce(r.status, '') <> '0x0'")
    logs = parsed.select("tx", "wallet", F.posexplode("r.logs").alias("place", "log"))
    account = lambda i: F.when(F.get("log.topics", F.lit(i)).rlike("^0x[0-9a-fA-F]{64}$"), F.lower(F.concat(F.lit("0x"), F.substring(F.get("log.topics", F.lit(i)), 27, 40))))
    moves = logs.where((F.lower(F.get("log.topics", F.lit(0))) == TRANSFER) & F.col("log.address").isNotNull()).select("tx", "wallet", "place", F.lower("log.address").alias("token"), account(1).alias("giver"), account(2).alias("taker"), padded(F.col("log.data")).alias("amount"))
    moved = moves.where((F.col("amount") != "0" * 64) & ~F.col("giver").eqNullSafe(F.col("taker"))).withColumn("way", F.when(F.col("giver") == F.col("wallet"), -1).when(F.col("taker") == F.col("wallet"), 1)).where("way IS NOT NULL")
    net = moved.groupBy("tx", "wallet", "token").agg(F.min("place").alias("place"), F.array(*[F.sum(x * F.col("way")) for x in limbs_of(F.col("amount"))]).alias("sums"))
    return net.select("tx", "wallet", "token", "place", sign(F.col("sums")).alias("sign"), digits(F.col("sums")).alias("raw"))


def solana_deltas(transactions: DataFrame) -> DataFrame:
    """tx, wallet, token, place, sign, raw and decimals of each mint's net change in a wallet, and of its native coin with the fee added back where it paid it.

    transactions: tx, wallet, body (JSON text). Failed ones have no rows.
    """
    parsed = transactions.select("tx", "wallet", F.from_json("body", TRANSACTION).alias("t")).select("tx", "wallet", "t.meta", F.col("t.transaction.message.accountKeys").alias("keys"))
    fine = parsed.where("meta.err IS NULL AND meta.preTokenBalances IS NOT NULL AND meta.postTokenBalances IS NOT NULL")
    side = lambda name, way, base: fine.select("tx", "wallet", F.posexplode(f"meta.{name}").alias("place", "b")).select("tx", "wallet", (F.col("place") + base).cast("long").alias("place"), "b", F.lit(way).alias("way"))
    both = side("preTokenBalances", -1, 0).unionByName(side("postTokenBalances", 1, 1_000_000))
    amount = F.col("b.uiTokenAmount.amount").try_cast("decimal(38,0)")
    own = both.where((F.col("b.owner") == F.col("wallet")) & F.col("b.mint").isNotNull() & amount.isNotNull() & F.col("b.uiTokenAmount.decimals").isNotNull())
    net = own.groupBy("tx", "wallet", F.col("b.mint").alias("token")).agg(F.min("place").alias("place"), F.sum(amount * F.col("way")).alias("net"), F.max("b.uiTokenAmount.decimals").alias("decimals"))
    at = F.array_position("keys", F.col("wallet"))
    change = F.coalesce(F.get("meta.postBalances", (at - 1).cast("int")), F.lit(0)) - F.coalesce(F.get("meta.preBalances", (at - 1).cast("int")), F.lit(0)) + F.when(at == 1, F.coalesce("meta.fee", F.lit(0.0))).otherwise(0).cast("decimal(20,0)")
    native = fine.where((at > 0) & F.col("meta.preBalances").isNotNull() & F.col("meta.postBalances").isNotNull()).select("tx", "wallet", F.lit("native").alias("token"), F.lit(1 << 40).alias("place"), change.cast("decimal(38,0)").alias("net"), F.lit(9).alias("decimals"))
    return net.select("tx", "wallet", "token", "place", F.col("net").cast("decimal(38,0)").alias("net"), "decimals").unionByName(native).select("tx", "wallet", "token", "place", F.signum("net").cast("int").alias("sign"), F.abs("net").cast("string").alias("raw"), "decimals")


def swaps(deltas: DataFrame, quotes: list[str]) -> DataFrame:
    """tx, wallet, side, token and quote with their columns of `deltas`: the first quote leg that meets a token leg of the opposite sign, and the first such token.

    quotes: configured names, a short list. Transactions without such a pair have no row.
    """
    legs = deltas.where((F.col("token") != ZERO) & (F.col("sign") != 0))
    extra = [c for c in deltas.columns if c not in ("tx", "wallet", "token", "place", "sign")]
    quote = legs.where(F.col("token").isin(quotes)).select("tx", "wallet", F.col("token").alias("quote"), F.col("place").alias("q_place"), F.col("sign").alias("q_sign"), *[F.col(c).alias(f"quote_{c}") for c in extra])
    token = legs.where(~F.col("token").isin(quotes)).select("tx", "wallet", "token", "place", "sign", *[F.col(c).alias(f"token_{c}") for c in extra])
    met = quote.join(token, ["tx", "wallet"]).where("sign = -q_sign")
    kept = ["q_sign", "token", *[f"token_{c}" for c in extra], "quote", *[f"quote_{c}" for c in extra]]
    first = met.groupBy("tx", "wallet").agg(F.min_by(F.struct(*kept), F.struct("q_place", "place")).alias("s"))
    return first.select("tx", "wallet", F.when(F.col("s.q_sign") < 0, "buy").otherwise("sell").alias("side"), *[F.col(f"s.{c}").alias(c) for c in kept[1:]])
