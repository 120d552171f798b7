"""Folds over streams: state between batches, rows in event-time order, timers that end states."""

from __future__ import annotations

import bisect
import heapq
import itertools
import operator
import pickle
import uuid
from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from driftline.operators.folds import Fold, State, fields

STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Rows of a key that are sorted together as they come, and rows of a piece of them.
BATCH, PIECE = 65_536, 2_048


def order(row: tuple) -> tuple:
    """By (at, id), null ids first."""
    return row[0], row[1] is not None, row[1]


class Folded(StatefulProcessor):
    """Runs a fold over a key's rows.

    Rows wait until the watermark has passed them and are then taken by (at, id), so that the result
    does not hang on how a stream is cut into batches. A timer stands for the first waiting row and
    for the state's next moment; both are gone from the store once nothing is left to wait for.

    Up to PIECE rows wait as one value of the store. More of them go to sorted pieces: of BATCH rows
    that come together a piece holds PIECE neighbours in time, and pieces are opened when their first
    row is due, so of a key with many rows only pieces that overlap are in memory.
    """

    def __init__(self, fold: Fold, keys: list[str]):
        self.fold, self.keys = fold, keys
        self.columns = ["at", "id", *fields(fold.rows)]
        self.names = [*keys, *fields(fold.output)]
        self.state = StructType.fromDDL(fold.state)  # here, as workers have no session to read it
        self.place, self.bytes = StructType.fromDDL("at long, number long"), StructType.fromDDL("rows binary")

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.kept = handle.getValueState("kept", self.state)
        self.waiting = handle.getValueState("waiting", self.bytes)
        self.pieces = handle.getMapState("pieces", self.place, self.bytes)

    def load(self) -> tuple[list[tuple[int, int]], list[tuple]]:
        """(time of its first row, number) of each piece, and the rows that are in none."""
        found = self.waiting.get()
        return ([], []) if found is None else pickle.loads(found[0])

    def save(self, places: list[tuple[int, int]], few: list[tuple]) -> None:
        self.waiting.update((pickle.dumps((places, few), pickle.HIGHEST_PROTOCOL),))

    def put(self, rows: list[tuple]) -> tuple[int, int]:
        """Makes a piece of sorted rows."""
        place = rows[0][0], uuid.uuid4().int >> 66
        self.pieces.updateValue(place, (pickle.dumps(rows, pickle.HIGHEST_PROTOCOL),))
        return place

    def due(self, places: list[tuple[int, int]], few: list[tuple], upto: int) -> Iterator[tuple]:
        """Waiting rows up to a time, in order. places: sorted; what is later in the pieces opened becomes pieces of their own, added there."""
        opened = [(order(few[0]), -1, few, 0)] if few else []  # order of its next row, which piece, its rows, which row
        for n, place in enumerate([*places, None]):
            begins = None if place is None or place[0] > upto else place[0]
            while opened and (begins is None or opened[0][0][0] < begins):
                _, k, rows, i = opened[0]
                yield rows[i]
                if i + 1 < len(rows):
                    heapq.heapreplace(opened, (order(rows[i + 1]), k, rows, i + 1))
                else:
                    heapq.heappop(opened)
            if begins is None:
                break
            rows = pickle.loads(self.pieces.getValue(place)[0])
            self.pieces.removeKey(place)
            places.remove(place)
            cut = bisect.bisect_right(rows, upto, key=lambda r: r[0])
            if cut < len(rows):
                places.append(self.put(rows[cut:]))
            heapq.heappush(opened, (order(rows[0]), n, rows[:cut], 0))

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        places, few = self.load()
        first, taken = None, None
        while new := list(itertools.islice(rows, BATCH)):
            taken = taken or operator.itemgetter(*map(new[0].__fields__.index, self.columns))
            new = [taken(tuple(r)) for r in new]
            first = min(r[0] for r in ([(first,), *new] if first is not None else new))
            few = sorted([*few, *new], key=order)
            if len(few) > PIECE:
                places += [self.put(few[i : i + PIECE]) for i in range(0, len(few), PIECE)]
                few = []
        if first is not None:
            self.save(places, few)
            self.handle.registerTimer(first)
        return iter(())

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        upto, told = timerValues.getCurrentWatermarkInMs(), Row(*self.names)
        old = self.kept.get()
        state: State | None = None if old is None else tuple(old)
        places, few = self.load()
        places.sort()
        held, cut = bool(places or few), bisect.bisect_right(few, upto, key=lambda r: r[0])
        few, ready = few[cut:], few[:cut]
        for row in self.due(places, ready, upto):
            state, out = self.fold.until(state, row[0], False)
            for o in out:
                yield told(*key, *o)
            state, out = self.fold.step(state, dict(zip(self.columns, row, strict=True)))
            for o in out:
                yield told(*key, *o)
        state, out = self.fold.until(state, upto, True)
        for o in out:
            yield told(*key, *o)
        if state is not None:
            self.kept.update(state)
        elif old is not None:
            self.kept.clear()
        if places or few:
            self.save(places, few)
        elif held:
            self.waiting.clear()
        moments = [min(x) for x in [[p[0] for p in places] + [r[0] for r in few[:1]]] if x]
        if state is not None and (due := self.fold.due(state)) is not None:
            moments.append(due)
        for moment in moments:
            self.handle.registerTimer(moment)

    def close(self) -> None:
        pass


def folded(frame: DataFrame, keys: list[str], fold: Fold, late: str = "0 seconds") -> DataFrame:
    """keys and `fold.output` of a stream with `ts`, `id` and the fold's columns: what `operators.folds.folded` gives over the same rows.

    Rows later than the watermark (`late` behind the newest) are dropped. The state of a key is the fold's own and the rows
    that wait for the watermark. The session keeps its state in RocksDB, beyond the executors' heap.
    """
    frame.sparkSession.conf.set(STORE, ROCKS)
    rows = frame.withColumn("at", F.unix_millis("ts")).withWatermark("ts", late)
    schema = StructType([*frame.select(*keys).schema.fields, *StructType.fromDDL(fold.output).fields])
    return rows.select("ts", "at", "id", *keys, *fields(fold.rows)).groupBy(*keys).transformWithState(Folded(fold, keys), schema, "append", "EventTime")
