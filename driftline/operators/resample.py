"""Deterministic resampling: day-block bootstrap and permutations with draws from integer arithmetic.

Draws are a fixed mix of (seed, replicate, place), so that any engine can repeat them; they are
generated where they are used, so neither rows nor days are multiplied by replicates in an exchange.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import pairwise
from operator import and_

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from driftline.session import checkpointed

M = 2_147_483_647
#: Replicates that a task draws at once, rows of a day that it holds, and draws of rows for replicates that it makes at once (they stay in a core's cache).
REPS, MOST_ROWS, CELLS = 100, 1_000_000, 32_768


def draw(seed: int, rep: Column, place: Column) -> Column:
    """A number in [0, 2^31 - 1)."""
    x = F.pmod(rep.cast("long") * 48271 + place.cast("long") * 16807 + F.lit(seed).cast("long") * 69621 + 1, F.lit(M))
    for a, c in ((48271, 11), (69621, 7), (16807, 3)):
        x = F.pmod(x * a + c, F.lit(M))
        x = F.pmod(x + F.shiftright(x, 13), F.lit(M))
    return x


def draw_sql(seed: int, rep: str, place: str) -> str:
    x = f"(({rep})::BIGINT * 48271 + ({place})::BIGINT * 16807 + {seed} * 69621 + 1) % {M}"
    for a, c in ((48271, 11), (69621, 7), (16807, 3)):
        x = f"(({x}) * {a} + {c}) % {M}"
        x = f"(({x}) + (({x}) >> 13)) % {M}"
    return x


def draws(seed: int, rep: np.ndarray, place: np.ndarray) -> np.ndarray:
    """As `draw`, of whole numbers in arrays."""
    x = (rep.astype(np.int64) * 48271 + place.astype(np.int64) * 16807 + seed * 69621 + 1) % M
    for a, c in ((48271, 11), (69621, 7), (16807, 3)):
        x = (x * a + c) % M
        x = (x + (x >> 13)) % M
    return x


def draw_table(seed: int, rep: np.ndarray, place: np.ndarray) -> np.ndarray:
    """As `draws`, (replicates, places) in 32 bits: a remainder by M = 2^31 - 1 is a sum of high and low bits, less M where that is not below it."""
    of_rep = ((rep.astype(np.int64) * 48271 + seed * 69621 + 1) % M).astype(np.uint64)
    of_place = (place.astype(np.int64) * 16807 % M).astype(np.uint64)
    out = np.empty((len(rep), len(place)), np.uint32)
    step = max(1, CELLS // max(1, len(place)))
    for i in range(0, len(rep), step):
        for j in range(0, len(place), CELLS):
            x = of_rep[i : i + step, None] + of_place[None, j : j + CELLS]  # below 2 M, which a factor's remainder allows
            high = np.empty_like(x)
            y = np.empty(x.shape, np.uint32)
            other = np.empty_like(y)
            for a, c in ((48271, 11), (69621, 7), (16807, 3)):
                x *= np.uint64(a)
                x += np.uint64(c)
                np.right_shift(x, np.uint64(31), out=high)
                x &= np.uint64(M)
                x += high
                np.copyto(y, x, casting="unsafe")  # below 2^32
                np.minimum(y, np.subtract(y, np.uint32(M), out=other), out=y)  # below M the difference wraps and is the larger
                y += np.right_shift(y, np.uint32(13), out=other)
                np.minimum(y, np.subtract(y, np.uint32(M), out=other), out=y)
                np.copyto(x, y)
            out[i : i + step, j : j + CELLS] = y
    return out


def smallest(numbers: np.ndarray, k: int) -> np.ndarray:
    """Where the k smallest numbers of each line are, the first ones of equal numbers."""
    last = np.partition(numbers, k - 1, axis=1)[:, k - 1 : k]
    found = numbers <= last
    for line in np.flatnonzero(np.count_nonzero(found, axis=1) > k):
        equal = np.flatnonzero(numbers[line] == last[line])
        found[line, equal[k - np.count_nonzero(numbers[line] < last[line]) :]] = False
    return found


def blocks(rows: DataFrame, keys: list[str], day: str, value: Column) -> DataFrame:
    """keys, days: of each key the sums and counts of its days, in order; one entry a day, so a few thousand at most."""
    days = rows.groupBy(*keys, day).agg(F.sum(value).alias("s"), F.count(value).alias("n"))
    return days.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(day).alias("day"), "s", "n"))).alias("days"))


def resampled(blocks: DataFrame, keys: list[str], reps: int, seed: int) -> DataFrame:
    """keys, m: the mean of each replicate's days, as many as the key has; replicates are drawn where the days are, REPS at a time."""
    kinds = blocks.select(*keys).schema
    arrow = to_arrow_schema(kinds).append(pa.field("m", pa.float64()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                s, n = (np.array(batch.column(c)[at].as_py()) for c in ("s", "n"))
                first = batch.column("first")[at].as_py()
                rep = np.arange(first, min(first + REPS, reps))
                pick = draws(seed, rep[:, None], np.arange(len(s))[None, :]) % len(s)
                count = n[pick].sum(1)
                means = np.divide(s[pick].sum(1), count, out=np.full(len(rep), np.nan), where=count > 0)
                yield pa.RecordBatch.from_arrays([*[pa.array([batch.column(k)[at].as_py()] * len(rep), arrow.field(k).type) for k in keys], pa.array(means, from_pandas=True)], schema=arrow)

    parts = F.explode(F.sequence(F.lit(0), F.lit(reps - 1), F.lit(REPS))).alias("first")
    spread = blocks.select(*keys, F.transform("days", lambda x: plain(x["s"], blocks)).alias("s"), F.col("days.n").alias("n"), parts).repartition(*keys, "first")
    return spread.mapInArrow(run, StructType([*kinds.fields, StructField("m", DoubleType())])).where("m IS NOT NULL")


def plain(s: Column, blocks: DataFrame) -> Column:
    """Sums as whole numbers where they are, else as doubles."""
    return s.cast("long") if isinstance(blocks.schema["days"].dataType.elementType["s"].dataType, LongType) else s.cast("double")


def bootstrap(rows: DataFrame, keys: list[str], day: str, value: Column, reps: int, seed: int, least: int = 3) -> DataFrame:
    """mean, low and high (2.5 and 97.5 %) by resampling whole days; low and high are null below `least` days or without width.

    Rows are summed to days map-side; a key's days, not its rows, are what replicates see. Null values count in no day.
    """
    days = blocks(rows, keys, day, value)
    ends = resampled(days, keys, reps, seed).groupBy(*keys).agg(F.percentile("m", F.lit(0.025)).alias("low"), F.percentile("m", F.lit(0.975)).alias("high"))
    add = lambda c: F.aggregate(F.col(f"days.{c}"), F.lit(0).cast(days.schema["days"].dataType.elementType[c].dataType), lambda a, x: a + F.coalesce(x, F.lit(0)))
    whole = days.select(*keys, (add("s").cast("double") / F.nullif(add("n"), F.lit(0))).alias("mean"), F.size("days").cast("long").alias("days"))
    fine = (F.col("days") >= least) & (F.col("high") > F.col("low"))
    return whole.join(ends, keys, "left").select(*keys, "mean", "days", F.when(fine, F.col("low")).alias("low"), F.when(fine, F.col("high")).alias("high"))


def flipped_means(days: DataFrame, keys: list[str], day_number: str, value: str, reps: int, seed: int) -> DataFrame:
    """keys, rep, m: means of daily values under random signs, which belong to (replicate, day), alike for all keys."""
    signed = days.select(*keys, value, F.col(day_number).alias("i"), F.explode(F.sequence(F.lit(0), F.lit(reps - 1))).alias("rep"))
    sign = F.when(F.pmod(F.shiftright(draw(seed, F.col("rep"), F.col("i")), 8), F.lit(2)) == 0, 1).otherwise(-1)
    return signed.groupBy(*keys, "rep").agg((F.sum(F.col(value) * sign) / F.count(F.lit(1))).alias("m"))


def daily_means(days: DataFrame, keys: list[str], value: str) -> DataFrame:
    return days.groupBy(*keys).agg((F.sum(value) / F.count(F.lit(1))).alias("mean"))


def sign_flip(days: DataFrame, keys: list[str], day_number: str, value: str, reps: int, seed: int) -> DataFrame:
    """p of the mean of daily values under random signs, (hits + 1) / (reps + 1)."""
    flipped, seen = flipped_means(days, keys, day_number, value, reps, seed), daily_means(days, keys, value)
    return flipped.join(seen, keys).groupBy(*keys).agg(((F.count_if(F.col("m") <= F.col("mean")) + 1) / (reps + 1)).alias("p"))


def sign_flip_family(days: DataFrame, key: str, day_number: str, value: str, reps: int, seed: int) -> DataFrame:
    """best (the key of the lowest mean, the first by name of equal ones), mean, p: how often the lowest mean of all keys under random signs is as low; one row, none without days.

    As all keys share a day's sign, the p holds for the choice of the best among them.
    """
    best = daily_means(days, [key], value).agg(F.min(F.struct("mean", key)).alias("b")).where("b IS NOT NULL").select(F.col(f"b.{key}").alias("best"), "b.mean")
    lowest = flipped_means(days, [key], day_number, value, reps, seed).groupBy("rep").agg(F.min("m").alias("m"))
    return lowest.join(F.broadcast(best)).groupBy("best", "mean").agg(((F.count_if(F.col("m") <= F.col("mean")) + 1) / (reps + 1)).alias("p"))  # one row


def within_day_permutation(rows: DataFrame, day: str, signal: str, identity: list[str], value: Column, reps: int, seed: int, number: Column, keys: list[str] | tuple[str, ...] = ()) -> DataFrame:
    """keys, rep, mean: of as many rows a day as had the signal, drawn without replacement; number: an integer of each row for its draws.

    `identity` (whole numbers) settles equal draws. A day of up to MOST_ROWS rows, two numbers each, is held by one
    task, which draws all its replicates; rows of larger days are spread over replicates and ranked by windows.
    """
    marked = rows.select(*keys, F.col(day).alias("__day"), value.alias("__v"), number.cast("long").alias("__x"), *[F.col(c).cast("long").alias(f"__i{i}") for i, c in enumerate(identity)], F.col(signal).alias("__signal"))
    days = [*keys, "__day"]
    sizes = marked.groupBy(*[F.col(c).alias(f"__of_{c}") for c in days]).agg(F.count_if("__signal").alias("__k"), F.count(F.lit(1)).alias("__rows"))
    beyond = F.broadcast(checkpointed(sizes.where(F.col("__rows") > MOST_ROWS)))  # a day for each MOST_ROWS rows at most
    same = reduce(and_, [F.col(c).eqNullSafe(F.col(f"__of_{c}")) for c in days])
    order = [f"__i{i}" for i in range(len(identity))]
    large = marked.join(beyond, same).where("__k > 0").drop("__signal", *[f"__of_{c}" for c in days]).select("*", F.explode(F.sequence(F.lit(0), F.lit(reps - 1))).alias("rep"))
    place = Window.partitionBy(*keys, "rep", "__day").orderBy(draw(seed, F.col("rep"), F.col("__x")), *order)
    far = large.select(*keys, "rep", "__v", "__k", F.row_number().over(place).alias("__r")).where("__r <= __k").groupBy(*keys, "rep").agg(F.sum("__v").cast("double").alias("__s"), F.count("__v").alias("__n"))
    near = drawn(marked.join(beyond, same, "left_anti"), list(keys), order, reps, seed)
    return far.unionByName(near).groupBy(*keys, "rep").agg((F.sum("__s") / F.sum("__n")).alias("mean"))


def drawn(marked: DataFrame, keys: list[str], order: list[str], reps: int, seed: int) -> DataFrame:
    """keys, rep, __s, __n: sums over a task's days of the rows drawn in each replicate; days without a signal draw none."""
    kinds = marked.select(*keys).schema
    schema = StructType([*kinds.fields, *StructType.fromDDL("rep int, __s double, __n long").fields])
    arrow = to_arrow_schema(schema)
    days = [*keys, "__day"]

    def one_day(table: pa.Table, k: int) -> tuple[np.ndarray, np.ndarray]:
        table = table.sort_by([(c, "ascending") for c in order])  # the first of equal draws is taken
        v = table.column("__v").to_numpy().astype(np.float64)
        x, known = table.column("__x").to_numpy(), ~np.isnan(v)
        s, n = np.zeros(reps), np.full(reps, k, np.int64)
        step = max(1, CELLS // len(x))  # replicates at once
        for first in range(0, reps, step):
            rep = np.arange(first, min(first + step, reps))
            got = smallest(draw_table(seed, rep, x), k)
            if np.isfinite(v).all():
                s[rep] = got @ v
            else:
                s[rep], n[rep] = np.where(got & known, v, 0).sum(1), np.count_nonzero(got & known, axis=1)
        return s, n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple, list[np.ndarray]] = {}
        held: list[pa.RecordBatch] = []
        now: tuple | None = None

        def end() -> None:
            table = pa.Table.from_batches(held) if held else None
            k = (pc.sum(table.column("__signal")).as_py() or 0) if held else 0
            if k:
                s, n = one_day(table, k)
                got = sums.setdefault(now[:-1], [np.zeros(reps), np.zeros(reps, np.int64)])
                got[0] += s
                got[1] += n
            held.clear()

        for batch in batches:
            changes = [np.diff(batch.column(c).dictionary_encode("encode").indices.to_numpy()) != 0 for c in days]
            ends = [0, *(np.flatnonzero(np.any(changes, axis=0)) + 1), batch.num_rows] if batch.num_rows else []
            for start, stop in pairwise(ends):
                of = tuple(batch.column(c)[start].as_py() for c in days)
                if of != now:
                    end()
                    now = of
                held.append(batch.slice(start, stop - start).drop_columns(days))
        end()
        for key, (s, n) in sums.items():
            yield pa.RecordBatch.from_arrays([*[pa.array([x] * reps, arrow.field(i).type) for i, x in enumerate(key)], pa.array(range(reps), pa.int32()), pa.array(s), pa.array(n)], schema=arrow)

    return marked.repartition(*days).sortWithinPartitions(*days).mapInArrow(run, schema)
