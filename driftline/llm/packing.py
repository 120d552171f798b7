"""Packing documents into training sequences by order-preserving dynamic programming."""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftline.llm import bytebpe

SEQUENCE = 1024
END_ID = 0
#: Costs in tokens of padding: a cut after a sentence, a cut elsewhere inside a document, and each sequence.
SENTENCE_CUT, HARD_CUT, PER_SEQUENCE = 1.0, 4.0, 96.0
#: Without a boundary for so many tokens, cuts elsewhere are allowed at this spacing.
HARD_EVERY = 20
#: Tokens that are planned together; plans settle long before the end of a block.
BLOCK = 262_144
#: Sequence ids of a partition start at its number times this.
PER_PARTITION = 1 << 36


def plan_cuts(ends: list[int], costs: list[float], size: int = SEQUENCE) -> list[int]:
    """Indices into `ends` where sequences end, at least total cost.

    `ends` are the allowed cuts, ascending, no further than `size` apart (the first from 0), the
    last one the end of all tokens; `costs` the cost of each. A sequence costs its padding to
    `size`, which a power of two of at least `size` / 8 spares, and PER_SEQUENCE. Padding is linear in the start of a
    sequence, so the best start within reach is the head of a monotone queue; starts at a power
    of two are looked up beside it. Each cut enters and leaves the queue once.
    """
    at = np.concatenate([[0], np.asarray(ends, np.int64)])
    where = np.full(int(at[-1]) + 1, -1, np.int64)
    where[at] = np.arange(len(at))
    powers = [p for k in range(size.bit_length()) if size // 8 <= (p := 1 << k) < size]
    at_power = np.stack([np.where(at >= p, where[np.maximum(at - p, 0)], -1) for p in powers]) if powers else np.empty((0, len(at)), np.int64)
    spared: list[tuple] = [()] * len(at)
    for i in np.flatnonzero((at_power >= 0).any(0)).tolist():  # few cuts have another at such a distance
        spared[i] = tuple(j for j in at_power[:, i].tolist() if j >= 0)
    at = at.tolist()
    best, came = [0.0] * len(at), [0] * len(at)
    waiting, starts, head, first = [0.0], [0], 0, 0  # best + start of each cut in the queue, ascending; the cuts; the first one's place
    for i, (end, cost, others) in enumerate(zip(at, (0.0, *costs), spared, strict=True)):
        if not i:
            continue
        while first < end - size:
            head += 1
            first = at[starts[head]]
        value, start = waiting[head] + size - end, starts[head]
        for j in others:
            if best[j] < value:
                value, start = best[j], j
        best[i] = value = value + cost + PER_SEQUENCE
        came[i] = start
        value += end
        while waiting[-1] >= value:
            waiting.pop()
            starts.pop()
            if len(waiting) == head:
                first = end
                break
        waiting.append(value)
        starts.append(i)
    cuts, i = [], len(at) - 1
    while i:
        cuts.append(i - 1)
        i = came[i]
    return cuts[::-1]


@cache
def sentence_ends(path: str) -> np.ndarray:
    """For each id, whether its token ends a sentence: a full stop, question or exclamation mark, or a line break."""
    bpe = bytebpe.load(path)
    ends = np.zeros(max([*bpe.ids.values(), *bpe.special.values()]) + 1, bool)
    for token, i in bpe.ids.items():
        ends[i] = token.rstrip(b"\"')").endswith((b".", b"!", b"?")) or b"\n" in token
    return ends


def allowed_cuts(ids: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Offsets in one document where it may be cut, its end included, and what each costs."""
    n = len(ids)
    soft = np.flatnonzero(ends[ids[: n - 2]]) + 1 if n > 2 else np.empty(0, np.int64)
    soft = np.append(soft, n)
    gaps = np.diff(soft, prepend=0)
    hard = (gaps - 1) // HARD_EVERY  # how many come before each soft one
    place = np.cumsum(hard + 1) - 1
    steps, costs = np.full(place[-1] + 1, HARD_EVERY), np.full(place[-1] + 1, HARD_CUT)
    steps[place], costs[place] = gaps - hard * HARD_EVERY, SENTENCE_CUT
    cuts = np.cumsum(steps)
    costs[-1] = 0.0
    return cuts, costs


class Packer:
    """Plans documents as they come; `pieces` are (document, start, length, sequence, offset, tokens of the sequence)."""

    def __init__(self, ends: np.ndarray, size: int = SEQUENCE, block: int = BLOCK):
        self.ends, self.size, self.block = ends, size, block
        self.waiting: list[list] = []  # document, offset of its first unplanned token, its cuts from there, costs, tokens
        self.tokens, self.sequence = 0, 0

    def add(self, document: object, ids: np.ndarray) -> Iterator[tuple]:
        cuts, costs = allowed_cuts(ids, self.ends)
        self.waiting.append([document, 0, cuts, costs, len(ids)])
        self.tokens += len(ids)
        if self.tokens >= self.block:
            yield from self.flush(False)

    def flush(self, final: bool) -> Iterator[tuple]:
        if not self.waiting:
            return
        at, all_cuts, all_costs = 0, [], []
        for _, first, cuts, costs, n in self.waiting:
            all_cuts.append(cuts + (at - first))
            all_costs.append(costs)
            at += n - first
        ends = np.concatenate(all_cuts).tolist()
        chosen = [ends[i] for i in plan_cuts(ends, np.concatenate(all_costs).tolist(), self.size)]
        if not final:  # the last sequences may still change with what follows
            chosen = [end for end in chosen if end <= at - 8 * self.size]
        begin, i, offset = 0, 0, 0
        for end in chosen:
            while begin < end:
                document, first, _, _, n = self.waiting[i]
                take = min(n - first, end - begin)
                yield document, first, take, self.sequence, offset
                self.waiting[i][1] += take
                begin += take
                offset += take
                i += first + take == n
            self.sequence, offset = self.sequence + 1, 0
        self.waiting = self.waiting[i:]
        if self.waiting:
            head = self.waiting[0]
            later = head[2] > head[1]
            head[2], head[3] = head[2][later], head[3][later]
        self.tokens = at - begin


def pack_ids(documents: Iterable[tuple[object, np.ndarray]], ends: np.ndarray, size: int = SEQUENCE, block: int = BLOCK) -> Iterator[tuple]:
    packer = Packer(ends, size, block)
    for document, ids in documents:
        yield from packer.add(document, ids)
    yield from packer.flush(True)


def pack(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, size: int = SEQUENCE, end_id: int = END_ID, remembered: int = bytebpe.REMEMBERED) -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document is its text's ids and then `end_id`; null and empty texts are that id alone. The
    documents of a partition follow each other in its order and are cut into sequences of at most
    `size` tokens: cuts at document ends are free, after sentences they cost SENTENCE_CUT tokens of
    padding, and HARD_CUT elsewhere, where only stretches of over HARD_EVERY tokens without
    a boundary may be cut. Dynamic programming finds the least total cost over blocks of BLOCK
    tokens; the sequences near a block's end are planned again with the next block, so memory is
    bounded by a block and the longest document, and the plan is the whole partition's for all
    practical purposes. No shuffle: ids of sequences start at partition number times 2^36. A task
    that runs again reads the same rows in the same order and returns the same pieces as long as
    `df` comes from files; sort a shuffled `df` within partitions first. Rows that repeat are
    packed as often as they come; no rows give no rows; other columns are ignored. A worker
    remembers the ids of `remembered` parts of lines, some 250 bytes each: fewer cost time, not results.
    """
    path = path or bytebpe.default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, ends = bytebpe.encoder(path, remembered).encode, sentence_ends(path)
        tail = int(end_id).to_bytes(4, "little")
        raws: dict[int, tuple] = {}  # number -> id, bytes of all its ids
        base = TaskContext.get().partitionId() * PER_PARTITION

        def numbered() -> Iterator[tuple[int, np.ndarray]]:
            number = 0
            for batch in batches:
                for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    raw = encode(text) + tail
                    raws[number] = (doc_id, raw)
                    yield number, np.frombuffer(raw, "<u4")
                    number += 1

        names = ["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
        rows: list[tuple] = []
        for number, start, length, sequence, offset in pack_ids(numbered(), ends, size):
            doc_id, raw = raws[number]
            rows.append((doc_id, start, length, zlib.crc32(memoryview(raw)[4 * start : 4 * (start + length)]), len(raw) // 4, base + sequence, offset))
            if 4 * (start + length) == len(raw):
                del raws[number]
            if len(rows) >= 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(c) if i else pa.array(c, id_type) for i, c in enumerate(zip(*rows, strict=True))], names=names)
                rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c) if i else pa.array(c, id_type) for i, c in enumerate(zip(*rows, strict=True))], names=names)

    rows = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("body"))
    kind = rows.schema["id"].dataType
    from pyspark.sql.pandas.types import to_arrow_type

    id_type = to_arrow_type(kind)
    schema = f"id {kind.simpleString()}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_col)
