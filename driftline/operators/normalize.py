"""Parsing untrusted records: canonical ids, JSON with null apart from zero, safe numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Forms of addresses.
EVM, BASE58 = "^0x[0-9a-fA-F]{40}$", "^[1-9A-HJ-NP-Za-km-z]{32,44}$"


def address(chain: Column, value: Column) -> Column:
    """Lower case for EVM chains, as it is for solana; null if malformed."""
    return F.when(chain == "solana", F.when(value.rlike(BASE58), value)).otherwise(F.when(value.rlike(EVM), F.lower(value)))


def number(value: Column) -> Column:
    """A finite double, or null."""
    x = value.try_cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), x)


def positive(value: Column) -> Column:
    x = number(value)
    return F.when(x > 0, x)


def market(raw: Column) -> Column:
    """Struct of a market record: price and fdv must be positive, the link https on an allowed host; zero volume stays zero, a missing one null."""
    at = lambda path: F.get_json_object(raw, path)
    link = at("$.url")
    safe = F.when(link.rlike("^https://") & F.try_parse_url(link, F.lit("HOST")).rlike(r"(^|\.)(dexscreener\.com|geckoterminal\.com)$"), link)
    return F.struct(
        at("$.pairAddress").alias("pool"), positive(at("$.priceUsd")).alias("price"), positive(at("$.fdv")).alias("fdv"),
        number(at("$.liquidity.usd")).alias("liquidity"), number(at("$.volume.h24")).alias("volume24"), safe.alias("link"),
    )


def swap_side(quote_delta: Column, token_delta: Column) -> Column:
    """buy if the quote went down and the token up, sell the other way round, else null."""
    return F.when((quote_delta < 0) & (token_delta > 0), "buy").when((quote_delta > 0) & (token_delta < 0), "sell")
