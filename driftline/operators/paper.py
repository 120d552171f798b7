"""Paper accounts in decimal arithmetic: many tokens share one account's cash, day and limits.

An account is a fold over its quotes and signals in time order, so that it runs over tables and
streams alike; its state is its open positions and the cooldowns of a day.
"""

from __future__ import annotations

from dataclasses import astuple, dataclass
from datetime import datetime
from decimal import ROUND_HALF_UP, Context, Decimal, localcontext
from functools import lru_cache
from zoneinfo import ZoneInfo

from pyspark.sql import DataFrame

from driftline.operators.folds import HOUR, Fold, folded

D = Decimal
#: Twenty significant digits, halves away from zero (fixed values); results are told to 18 places.
DIGITS, WIDE = Context(prec=20, rounding=ROUND_HALF_UP), Context(prec=38, rounding=ROUND_HALF_UP)
PLACES = D(1).scaleb(-18)

#: Why an entry is refused, in the order in which it is asked (fixed values).
REASONS = {
    "policy": "Policy changed; existing account must be reviewed",
    "paused": "New entries paused",
    "signal": "Signal is historical, future, or expired",
    "quote": "Fresh exact-pool price unavailable",
    "marks": "Open-position prices are stale",
    "token": "Token already held or on 24h cooldown",
    "positions": "Open-position limit reached",
    "entries": "Daily entry limit reached",
    "loss": "Daily loss threshold reached; new entries halted",
    "cash": "Insufficient virtual cash",
    "costs": "Assumed entry/exit costs would breach daily loss threshold",
}


@dataclass(frozen=True)
class Policy:
    """An account's rules: shares are fractions of one, spans are ms."""

    bankroll: D = D(100)
    order: D = D(10)
    most_positions: int = 3
    most_entries: int = 3
    daily_loss: D = D(20)
    stop: D = D("0.5")
    profit: D = D("0.5")
    sell: D = D("0.5")
    trail: D = D("0.3")
    fee: D = D(0)
    slip: D = D(0)
    network: D = D(0)
    fresh: int = 60_000
    signal_age: int = 300_000
    cooldown: int = 24 * HOUR
    zone: str = "America/Phoenix"

    def __post_init__(self) -> None:
        if not (0 < self.order <= self.bankroll and 0 <= self.network < self.order and 0 < self.daily_loss <= self.bankroll):
            raise ValueError("invalid bankroll, order size, costs or daily loss")
        if not (0 < self.stop < 1 and self.profit > 0 and 0 < self.sell <= 1 and 0 < self.trail < 1 and 0 <= self.fee < 1 and 0 <= self.slip < 1 and self.most_positions > 0 and self.most_entries > 0):
            raise ValueError("invalid levels, fees or limits")

    def name(self) -> str:
        return "|".join(map(str, astuple(self)))

    def proceeds(self, quantity: D, price: D) -> D:
        """What a sale brings after slippage and fees, never below nothing."""
        return max(D(0), quantity * price * (1 - self.slip) * (1 - self.fee) - self.network)


@dataclass
class Holding:
    token: str
    pool: str
    quantity: D
    cost: D
    high: D
    taken: bool
    mark: D
    marked: int


@lru_cache(maxsize=4096)
def day_of(hour: int, zone: str) -> str:
    """The local day of an hour since the epoch; zones of quarter hours are taken by their hour."""
    return datetime.fromtimestamp(hour * 3600, ZoneInfo(zone)).strftime("%Y-%m-%d")


class Account(Fold):
    """Entries, marks and sales of one account.

    Rows are a `quote` (token, pool, price, quote_at), a `signal` (token, pool, signal_at and the
    pool's quote), a `pause` or a `resume`; others change nothing. Out: one row for each signal (`enter` or
    `refuse`, with the first reason that holds) and for each sale (`stop`, `trail`, `profit`). A day's loss counts from the
    equity last known when the day began. A state of another policy is left alone, and each quote and signal is refused.
    """

    rows = "kind string, token string, pool string, price double, quote_at long, signal_at long"
    state = (
        "policy string, created long, cash string, realized string, paused boolean, day string, day_start string, entries int, tokens array<string>, pools array<string>, quantities array<string>, costs array<string>, "
        "highs array<string>, taken array<boolean>, marks array<string>, marked array<long>, cooled array<string>, cooled_at array<long>"
    )
    output = "id long, at long, event string, reason string, token string, quantity decimal(38,18), price decimal(38,18), cash_change decimal(38,18), realized decimal(38,18), cash decimal(38,18), equity decimal(38,18)"

    def __init__(self, policy: Policy = Policy()):
        self.policy, self.name = policy, policy.name()

    def step(self, state, row):
        with localcontext(DIGITS):
            return self.stepped(state, row)

    def stepped(self, state, row):
        p, at = self.policy, row["at"]
        today = day_of(at // HOUR, p.zone)
        if state is None:
            state = (self.name, at, str(p.bankroll), "0", False, today, str(p.bankroll), 0, *([] for _ in range(10)))
        if state[0] != self.name:
            return state, [(row["id"], at, "refuse", REASONS["policy"], row["token"], *[None] * 6)] if row["kind"] in ("quote", "signal") else []
        _, created, cash, realized, paused, day, day_start, entries, *lists = state
        cash, realized, day_start = D(cash), D(realized), D(day_start)
        holdings = [Holding(t, o, D(q), D(c), D(h), k, D(m), a) for t, o, q, c, h, k, m, a in zip(*lists[:8], strict=True)]
        cooled = {t: a for t, a in zip(*lists[8:], strict=True) if at - a <= p.cooldown}
        equity = lambda: sum((p.proceeds(x.quantity, x.mark) for x in holdings), cash)
        if day != today:
            day, day_start, entries = today, equity(), 0
        token, pool, price, quote_at = row["token"], row["pool"], row["price"], row["quote_at"]
        valid = None not in (token, pool, price, quote_at) and 0 < price < float("inf") and 0 <= at - quote_at <= p.fresh
        out: list[tuple] = []

        def tell(event: str, reason: str | None, *numbers: D | None) -> None:
            out.append((row["id"], at, event, reason, token, *[None if x is None else x.quantize(PLACES, context=WIDE) for x in (*numbers, cash, equity())]))

        if row["kind"] in ("pause", "resume"):
            paused = row["kind"] == "pause"
        elif row["kind"] == "quote" and valid:
            quote = D(repr(price))
            for x in [x for x in holdings if (x.token, x.pool) == (token, pool) and quote_at > x.marked]:
                x.mark, x.marked, x.high = quote, quote_at, max(x.high, quote)
                worth = p.proceeds(x.quantity, quote)
                if worth <= x.cost * (1 - p.stop):
                    event = "stop"
                elif x.taken and quote <= x.high * (1 - p.trail):
                    event = "trail"
                elif not x.taken and worth >= x.cost * (1 + p.profit):
                    event, x.taken = "profit", True
                else:
                    continue
                share = p.sell if event == "profit" else D(1)
                quantity, cost = x.quantity * share, x.cost * share
                got = p.proceeds(quantity, quote)
                cash, realized, x.quantity, x.cost = cash + got, realized + got - cost, x.quantity - quantity, x.cost - cost
                holdings = [y for y in holdings if y.quantity != 0]
                tell(event, None, quantity, quote * (1 - p.slip), got, got - cost)
        elif row["kind"] == "signal":
            sent = row["signal_at"]
            quote = D(repr(price)) if valid else D(1)
            fill = quote * (1 + p.slip)
            quantity = (p.order - p.network) / (1 + p.fee) / fill
            checks = [
                ("paused", paused), ("signal", sent is None or sent < created or not 0 <= at - sent <= p.signal_age), ("quote", not valid), ("marks", any(at - x.marked > p.fresh for x in holdings)),
                ("token", token in cooled or any(x.token == token for x in holdings)), ("positions", len(holdings) >= p.most_positions), ("entries", entries >= p.most_entries),
                ("loss", day_start - equity() >= p.daily_loss), ("cash", cash < p.order), ("costs", day_start - (equity() - p.order + p.proceeds(quantity, quote)) >= p.daily_loss),
            ]
            refused = next((name for name, holds in checks if holds), None)
            if refused:
                tell("refuse", REASONS[refused], None, None, None, None)
            else:
                cash, entries, cooled[token] = cash - p.order, entries + 1, at
                holdings.append(Holding(token, pool, quantity, p.order, fill, False, quote, quote_at))
                tell("enter", None, quantity, fill, -p.order, D(0))

        text = lambda name: [str(getattr(x, name)) for x in holdings]
        kept = ([x.token for x in holdings], [x.pool for x in holdings], text("quantity"), text("cost"), text("high"), [x.taken for x in holdings], text("mark"), [x.marked for x in holdings], list(cooled), list(cooled.values()))
        return (self.name, created, str(cash), str(realized), paused, day, str(day_start), entries, *kept), out


def replay(rows: DataFrame, keys: list[str], policy: Policy = Policy()) -> DataFrame:
    """keys and `Account.output` of each account over its rows (at, id and `Account.rows`)."""
    return folded(rows, keys, Account(policy))
