"""Recurrences over a key's rows in time order, said once and run over tables or streams.

A fold tells what one row or one moment does to a key's state. Over a table, a key's rows pass
through one task in order, never gathered: memory is the state's. Over a stream,
`driftline.streaming.stateful` keeps the state between batches and wakes it by event-time timers.
Moments that a state waits for come after rows of the same time.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any, ClassVar

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

HOUR = 3_600_000
State = tuple[Any, ...]


class Fold:
    """What a recurrence is: columns of a row beside `at` (ms) and `id`, columns of the state and of what comes out.

    `step` and `wake` give the new state (None ends it) and rows of `output`; `due` gives the next
    moment at which something happens without a row.
    """

    rows: ClassVar[str]
    state: ClassVar[str]
    output: ClassVar[str]

    def step(self, state: State | None, row: dict[str, Any]) -> tuple[State | None, list[tuple]]:
        raise NotImplementedError

    def due(self, state: State) -> int | None:
        return None

    def wake(self, state: State, at: int) -> tuple[State | None, list[tuple]]:
        raise NotImplementedError

    def until(self, state: State | None, at: int, inclusive: bool) -> tuple[State | None, list[tuple]]:
        """All moments before `at`, or up to it."""
        out: list[tuple] = []
        while state is not None and (due := self.due(state)) is not None and (due < at or (inclusive and due == at)):
            state, more = self.wake(state, due)
            out += more
        return state, out


def fields(schema: str) -> list[str]:
    return StructType.fromDDL(schema).fieldNames()


def folded(rows: DataFrame, keys: list[str], fold: Fold, now: int | None = None) -> DataFrame:
    """keys and `fold.output`, by one exchange and one sort; states left at a key's end wait up to `now`.

    A key is one task's work, as each row's outcome hangs on the one before; nulls in a key are a
    key of their own; rows with a null time take no part; no rows give none.
    """
    columns = ["at", "id", *fields(fold.rows)]
    kinds = rows.select(*keys).schema
    schema = StructType([*kinds.fields, *StructType.fromDDL(fold.output).fields])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key: tuple | None = None
        state: State | None = None
        out: list[tuple] = []

        def end() -> None:
            if key is not None and now is not None:
                _, more = fold.until(state, now, True)
                out.extend((*key, *m) for m in more)

        for batch in batches:
            for row in batch.to_pylist():
                own = tuple(row[k] for k in keys)
                if own != key:
                    end()
                    key, state = own, None
                state, early = fold.until(state, row["at"], False)
                state, more = fold.step(state, row)
                out.extend((*own, *m) for m in [*early, *more])
            yield table(out)
            out.clear()
        end()
        yield table(out)

    def table(out: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*out, strict=True)) or [()] * len(arrow)
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    dealt = rows.where("at IS NOT NULL").select(*keys, *columns).repartition(*keys).sortWithinPartitions(*keys, "at", "id")
    return dealt.mapInArrow(run, schema)


class Admission(Fold):
    """A limiter: at most `most` admissions count at a time, and one a token; a refused request uses nothing up.

    A row has its token, whether it is fresh enough to be looked at, and until when it counts if
    admitted. Out: id, at, admitted, reason (stale, limit or token). The state, one entry an
    admission that still counts, ends with the last of them.
    """

    rows = "token string, fresh boolean, until long"
    state = "tokens array<string>, untils array<long>"
    output = "id long, at long, admitted boolean, reason string"

    def __init__(self, most: int):
        self.most = most

    def step(self, state, row):
        held = [(t, u) for t, u in zip(*(state or ((), ())), strict=True) if u > row["at"]]
        reason = "stale" if not row["fresh"] else "limit" if len(held) >= self.most else "token" if any(t == row["token"] for t, _ in held) else None
        if reason is None:
            held.append((row["token"], row["until"]))
        return (([t for t, _ in held], [u for _, u in held]) if held else None), [(row["id"], row["at"], reason is None, reason)]

    def due(self, state):
        return max(state[1])

    def wake(self, state, at):
        return None, []


class Outcome(Fold):
    """What follows a key's first price within `length`: extremes and first times at its levels, complete by the clock, without a further row.

    Levels are multiples of the first price. A stop counts only if it comes first; both profit
    levels count whenever reached. The first row after a complete outcome begins the next one.
    """

    rows = "price double"
    state = "since long, entry double, low double, high double, first string, stop_at long, tp1_at long, tp2_at long, n long"
    output = "since long, entry double, low double, high double, first_hit string, stop_at long, tp1_at long, tp2_at long, n long"

    def __init__(self, stop: float, tp1: float, tp2: float, length: int = 24 * HOUR):
        if not stop < 1 < tp1 < tp2:
            raise ValueError("levels must be stop < 1 < tp1 < tp2")
        self.levels, self.length = (stop, tp1, tp2), length

    def step(self, state, row):
        at, price = row["at"], row["price"]
        if price is None or not price > 0:
            return state, []
        since, entry, low, high, first, stop_at, tp1_at, tp2_at, n = state or (at, price, price, price, None, None, None, None, 0)
        stop, tp1, tp2 = (entry * x for x in self.levels)
        if first is None and price <= stop:
            first, stop_at = "stop", at
        if first is None and price >= tp1:
            first = "tp1"
        if tp1_at is None and price >= tp1:
            tp1_at = at
        if tp2_at is None and price >= tp2:
            tp2_at = at
        return (since, entry, min(low, price), max(high, price), first, stop_at, tp1_at, tp2_at, n + 1), []

    def due(self, state):
        return state[0] + self.length

    def wake(self, state, at):
        return None, [tuple(state)]


class Position(Fold):
    """Events of one position a key at a time: stop, tp2, tp1, trail or breakeven, liquidity, the first that holds, each kind once.

    Stop, tp1 and tp2 are multiples of the first price. After tp1 the rest is closed by a stop that
    trails the highest price by `trail` percent and never falls below the entry, or without `trail` at the
    entry. Liquidity warns below 10,000 or half the first. The first row after an end opens the
    next position.
    """

    rows = "price double, liquidity double"
    state = "since long, entry double, depth double, half boolean, high double, warned boolean, tp1 boolean"
    output = "since long, at long, kind string, price double, level double"
    LEAST_LIQUIDITY = 10_000.0

    def __init__(self, stop: float, tp1: float, tp2: float | None, trail: float | None):
        self.stop, self.tp1, self.tp2, self.trail = stop, tp1, tp2, trail

    def step(self, state, row):
        at, price, liquidity = row["at"], row["price"], row["liquidity"]
        if price is None or not price > 0:
            return state, []
        since, entry, depth, half, high, warned, had_tp1 = state or (at, price, liquidity, False, None, False, False)
        if half and self.trail is not None:
            high = max(high, price)
        trailing = max(entry, high * (1 - self.trail / 100)) if half and self.trail is not None else None
        kind = level = None
        if not half and price <= entry * self.stop:
            kind, level = "stop", entry * self.stop
        elif self.tp2 is not None and price >= entry * self.tp2:
            kind, level = "tp2", entry * self.tp2
        elif not half and price >= entry * self.tp1:
            kind, level = "tp1", entry * self.tp1
        elif trailing is not None and price <= trailing:
            kind, level = "trail", trailing
        elif half and trailing is None and price <= entry:
            kind, level = "breakeven", entry
        elif liquidity is not None and liquidity < max(self.LEAST_LIQUIDITY, (depth or 0.0) * 0.5):
            kind, level = "liquidity", max(self.LEAST_LIQUIDITY, (depth or 0.0) * 0.5)
        if kind is None or (kind == "liquidity" and warned) or (kind == "tp1" and had_tp1):
            return (since, entry, depth, half, high, warned, had_tp1), []
        event = [(since, at, kind, price, level)]
        if kind in ("stop", "tp2", "trail", "breakeven"):
            return None, event
        if kind == "tp1":
            half, had_tp1, high = True, True, max(entry * self.tp1, price)
        return (since, entry, depth, half, high, warned or kind == "liquidity", had_tp1), event


class Coverage(Fold):
    """A source's health: warming for `warm` ms after a gap, else healthy while a row is younger than `fresh` ms, else stale; a row out at each change."""

    rows = "gap boolean"
    state = "warm_until long, fresh_until long, status string"
    output = "at long, status string"

    def __init__(self, warm: int, fresh: int):
        self.warm, self.fresh = warm, fresh

    def told(self, warm_until: int, fresh_until: int, before: str | None, at: int) -> tuple[State | None, list[tuple]]:
        status = "warming" if warm_until > at else "healthy" if fresh_until > at else "stale"
        return (warm_until, fresh_until, status), [(at, status)] if status != before else []

    def step(self, state, row):
        warm_until, fresh_until, before = state or (0, 0, None)
        at = row["at"]
        return self.told(at + self.warm if row["gap"] else warm_until, fresh_until if row["gap"] else at + self.fresh, before, at)

    def due(self, state):
        warm_until, fresh_until, status = state
        return warm_until if status == "warming" else fresh_until if status == "healthy" else None

    def wake(self, state, at):
        return self.told(*state, at)


class Delivery(Fold):
    """At-most-once delivery of a key's message: reserved, sending, then sent, unknown or failed.

    Rows are wishes (`to`): a reservation of a key that has none, a start within `begin` ms of it,
    an end of a start. What is neither ended nor failed after `give_up` ms becomes unknown by the clock, and
    is never tried again. Out: id (null for the clock), at, status of each change that was allowed.
    The state is kept for `keep` ms after the end, for keys that come back.
    """

    rows = "to string"
    state = "status string, since long, ended long"
    output = "id long, at long, status string"

    def __init__(self, begin: int = 60_000, give_up: int = 120_000, keep: int = 24 * HOUR):
        self.begin, self.give_up, self.keep = begin, give_up, keep

    def step(self, state, row):
        at, to = row["at"], row["to"]
        status, since, ended = state or (None, None, None)
        if status is None and to == "reserved":
            return ("reserved", at, None), [(row["id"], at, to)]
        if status == "reserved" and to == "sending" and at - since < self.begin:
            return ("sending", since, None), [(row["id"], at, to)]
        if status == "sending" and to in ("sent", "unknown", "failed"):
            return (to, since, at), [(row["id"], at, to)]
        return state, []

    def due(self, state):
        return state[2] + self.keep if state[2] is not None else state[1] + self.give_up

    def wake(self, state, at):
        return (None, []) if state[2] is not None else (("unknown", state[1], at), [(None, at, "unknown")])
