"""Gates of a candidate in order, its score in five parts, and first hits of its levels.

The market screen's conditions are SQL over a candidate's numbers, so that a catalogue of them is data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftline.operators.screening import clamp, reasons

#: Bounds of the strategy (fixed values).
MIN_AGE, MAX_AGE, MIN_LIQUIDITY, MIN_VOLUME, MIN_SWAPS, MIN_BUYERS, MIN_COUNT_RATIO, MIN_USD_RATIO, MAX_BUYER, MAX_FIVE, MAX_FDV, MAX_MOVE, ALERT = 10, 1440, 50_000, 10_000, 30, 20, 1.2, 1.3, 0.2, 0.6, 20, 25, 60

#: The market screen: thirteen reasons.
MARKET = [
    ("young", f"age_minutes < {MIN_AGE}"), ("old", f"age_minutes > {MAX_AGE}"), ("liquidity", f"liquidity < {MIN_LIQUIDITY}"), ("volume", f"volume < {MIN_VOLUME}"), ("price", "unpriced"), ("swaps", f"buys + sells < {MIN_SWAPS}"),
    ("count ratio", f"buys < {MIN_COUNT_RATIO} * greatest(1, sells)"), ("buyers unknown", "uncounted"), ("buyers", f"NOT uncounted AND buyers < {MIN_BUYERS}"), ("unmatched", "unmatched"),
    ("pool liquidity", f"NOT unmatched AND liquidity * 9 < {MIN_LIQUIDITY} * 10"), ("valuation", f"NOT unmatched AND fdv > {MAX_FDV} * liquidity"), ("extended", f"NOT unmatched AND price_change > {MAX_MOVE}"),
]
#: What users read when a gate rejects, in the order of the gates (fixed values).
UNCOVERED, UNTRADEABLE, UNSAFE, SECURITY_STALE, NO_MARKET = "Confirmed provider coverage unavailable", "Research only: support unconfirmed", "Security", "Security result stale", "Market data unavailable"
LOW_VOLUME, FEW_SWAPS, FEW_BUYERS, COUNT_RATIO, USD_RATIO = "Five-minute volume below minimum", "Too few five-minute swaps", "Too few unique buyers", "Buy/sell transaction ratio too low", "Buy/sell USD ratio too low"
ONE_BUYER, FIVE_BUYERS, MISMATCH, AGE, MARKET_STALE = "Single buyer dominates flow", "Top five buyers dominate flow", "Market identity mismatch", "Pool age outside allowed range", "Market data stale"
LOW_LIQUIDITY, VALUATION, PRICE, EXTENDED, DRAINED = "Liquidity below minimum", "FDV/liquidity too high or unknown", "Price invalid", "Five-minute price move extended or unknown", "Liquidity fell more than 10%"
LOW_SCORE = f"Score below {ALERT}"
#: Why a candidate is worth a look (fixed values).
WHY = ["Distributed buy flow", "Rising volume across three windows", "Controlled pullback above 21 EMA", "Liquidity comfortably above minimum"]
PARTS = ["liquidity", "buyers", "acceleration", "structure", "age_valuation"]
MINUTE = 60_000


def failed(checks: list[tuple[str, str]]) -> Column:
    return reasons([(name, F.expr(condition)) for name, condition in checks])


def finite(name: str) -> Column:
    """A number, or null where it is none or not finite."""
    return F.when(F.abs(F.col(name)) < float("inf"), F.col(name))


def evaluate(rows: DataFrame) -> DataFrame:
    """Adds reasons (of twenty gates, in order), the five parts of the score, score, why, qualifies.

    Rows are candidates at their time `at`: covered, tradeable, security (its status), security_reasons (text), checked_at;
    market (whether there is one), matches (it is the candidate's), created_at, fetched_at, pool, liquidity, min_liquidity, fdv, price, price_change;
    volume, buys, sells, buyers, usd_ratio, top_buyer, top_five, previous_volume, preceding_volume, minute_share, flow_change,
    higher_lows, ema21, sma50, pullback; rule, and of the snapshot before: before_at, before_rule, before_pool, before_liquidity
    (null without one). A number that is unknown fails its gate; gates of a missing market are not asked. With any
    reason score and parts are null; a score below 60 is a reason of its own.
    """
    c = F.col
    unsafe = lambda x: F.coalesce(x, F.lit(True))
    stale = lambda name: unsafe((c("at") - c(name) > MINUTE) | (c(name) > c("at")))
    liquidity, fdv, price, change = finite("liquidity"), finite("fdv"), finite("price"), finite("price_change")
    same_pool = F.coalesce(c("before_pool") == c("pool"), F.lit(False))
    age = c("at") - c("created_at")
    always = [
        (F.lit(UNCOVERED), ~F.coalesce("covered", F.lit(False))), (F.lit(UNTRADEABLE), ~F.coalesce("tradeable", F.lit(False))), (F.concat(F.lit(UNSAFE + " "), F.coalesce("security", F.lit("UNKNOWN")), F.lit(": "), F.coalesce("security_reasons", F.lit(""))), unsafe(c("security") != "PASS")),
        (F.lit(SECURITY_STALE), stale("checked_at")), (F.lit(NO_MARKET), ~F.coalesce("market", F.lit(False))), (F.lit(LOW_VOLUME), unsafe(finite("volume") < MIN_VOLUME)), (F.lit(FEW_SWAPS), unsafe(c("buys") + c("sells") < MIN_SWAPS)), (F.lit(FEW_BUYERS), unsafe(c("buyers") < MIN_BUYERS)),
        (F.lit(COUNT_RATIO), unsafe(c("buys") / F.greatest(F.lit(1), "sells") < MIN_COUNT_RATIO)), (F.lit(USD_RATIO), unsafe(F.nanvl(c("usd_ratio").cast("double"), F.lit(None).cast("double")) < MIN_USD_RATIO)), (F.lit(ONE_BUYER), unsafe(c("top_buyer") > MAX_BUYER)), (F.lit(FIVE_BUYERS), unsafe(c("top_five") > MAX_FIVE)),
    ]
    of_market = [
        (F.lit(MISMATCH), ~F.coalesce("matches", F.lit(False))), (F.lit(AGE), unsafe((age < MIN_AGE * MINUTE) | (age > MAX_AGE * MINUTE))), (F.lit(MARKET_STALE), stale("fetched_at")), (F.lit(LOW_LIQUIDITY), unsafe(liquidity < c("min_liquidity"))),
        (F.lit(VALUATION), unsafe((fdv <= 0) | (fdv > MAX_FDV * liquidity))), (F.lit(PRICE), unsafe(price <= 0)), (F.lit(EXTENDED), unsafe(change > MAX_MOVE) | (F.coalesce("flow_change", F.lit(0.0)) > MAX_MOVE)),
        (F.lit(DRAINED), F.coalesce((c("before_rule") == c("rule")) & (c("at") - c("before_at") <= 3 * MINUTE) & same_pool & (liquidity < c("before_liquidity") * 0.9), F.lit(False))),
    ]
    gates = [(text, holds) for text, holds in always] + [(text, c("market") & holds) for text, holds in of_market]
    found = rows.withColumn("reasons", F.array_compact(F.array(*[F.when(holds, text) for text, holds in gates])))

    valuation = F.try_divide(fdv, liquidity)
    cheap = clamp((20 - valuation) / 15)
    rising = (c("preceding_volume") > 0) & (c("previous_volume") > c("preceding_volume")) & (c("volume") > c("previous_volume"))
    controlled = c("pullback").between(0.01, 0.15)
    points = lambda holds, n, other=0: F.when(holds, n).otherwise(other)
    scores = {  # weights are fixed values
        "liquidity": 10 * clamp(liquidity / (3 * c("min_liquidity"))) + 10 * cheap + points(same_pool & (liquidity >= c("before_liquidity")), 5, 2),
        "buyers": 10 * clamp(c("buyers") / 100) + 8 * clamp((c("usd_ratio") - 1) / 1.5) + 7 * clamp(1 - c("top_five") / 0.6),
        "acceleration": points(c("previous_volume") > 0, 10 * clamp((F.try_divide("volume", "previous_volume") - 1) / 1.5), 0.0) + points(rising, 5) + points(c("minute_share") <= 0.35, 5),
        "structure": points(c("higher_lows"), 5) + points(price > c("ema21"), 4) + points(c("ema21") > c("sma50"), 3) + points(controlled, 3),
        "age_valuation": points(age <= 720 * MINUTE, 8, 4) + 7 * cheap,
    }
    clean = F.size("reasons") == 0
    scored = found.withColumns({f"{k}_points": F.when(clean, F.floor(v + 0.5).cast("long")) for k, v in scores.items()})
    scored = scored.withColumn("score", sum((c(f"{k}_points") for k in PARTS[1:]), c(f"{PARTS[0]}_points")))
    why = zip(WHY, [c("top_five") < 0.3, rising, (price > c("ema21")) & controlled, liquidity >= 2 * c("min_liquidity")], strict=True)
    told = F.array_compact(F.array(*[F.when(holds, F.lit(text)) for text, holds in why]))
    scored = scored.withColumn("why", F.when(clean, told).otherwise(F.array().cast("array<string>")))
    return scored.withColumns({"qualifies": F.coalesce(c("score") >= ALERT, F.lit(False)), "reasons": F.when(c("score") < ALERT, F.array(F.lit(LOW_SCORE))).otherwise(c("reasons"))})


def first_hits(prices: DataFrame, key: str, stop: float, tp1: float, tp2: float, length: int) -> DataFrame:
    """key, first_hit (stop or tp1), stop_at (only if it came first), tp1_at, tp2_at, low, high, complete: levels are multiples of the first price."""
    w = Window.partitionBy(key).orderBy("at", "id")
    p = prices.select(key, "at", "price", F.first("price").over(w).alias("e"), F.first("at").over(w).alias("t0"))
    first = lambda c: F.min(F.when(c, F.col("at")))
    g = p.groupBy(key).agg(
        first(F.col("price") <= F.col("e") * stop).alias("s"), first(F.col("price") >= F.col("e") * tp1).alias("tp1_at"), first(F.col("price") >= F.col("e") * tp2).alias("tp2_at"),
        F.min("price").alias("low"), F.max("price").alias("high"), (F.max("at") - F.min("t0") >= length).alias("complete"),
    )
    stopped = F.col("s").isNotNull() & (F.col("tp1_at").isNull() | (F.col("s") <= F.col("tp1_at")))
    return g.select(key, F.when(stopped, "stop").when(F.col("tp1_at").isNotNull(), "tp1").alias("first_hit"), F.when(stopped, F.col("s")).alias("stop_at"), "tp1_at", "tp2_at", "low", "high", "complete")
