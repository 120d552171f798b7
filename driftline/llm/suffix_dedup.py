"""Removal of long strings that occur earlier: a cover of suffixes is sampled, named and matched, then the windows between."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftline.llm.common import checkpointed
from driftline.llm.minimizers import U, gram_hashes, mix, range_hashes, window_minima

#: Bytes of a string that counts, and of the sampled suffixes' first names.
LENGTH, GRAM = 100, 32
#: Groups of one name with more different surroundings than this are matched window by window over the cluster.
LARGE = 4096
#: Text that a task samples before it sends names on.
BLOCK_BYTES = 32 << 20
NO_ID = -(2**63)

#: A run of windows that share their sampled suffix: name, name of the run's whole text, place, number of windows, offset of the suffix.
RUN = np.dtype([("gram", "<u8"), ("region", "<u8"), ("doc", "<i8"), ("lo", "<u4"), ("n", "u1"), ("at", "u1")])
#: Windows found again: place of the first, how many.
FLAG = np.dtype([("doc", "<i8"), ("lo", "<u4"), ("n", "u1")])
#: One window: name, place.
WINDOW = np.dtype([("key", "<u8"), ("doc", "<i8"), ("lo", "<u4")])
RUNS, FLAGS, SEEDS, LARGE_SEEDS, REGIONS, WINDOWS = range(6)
SCHEMA = "bucket int, kind int, payload binary"


def packed(rows: np.ndarray) -> bytes:
    """Bytes plane by plane, so that the shuffle's compression sees the like ones together."""
    return np.ascontiguousarray(rows.view(np.uint8).reshape(len(rows), rows.dtype.itemsize).T).tobytes()


def unpacked(payloads: list[bytes], dtype: np.dtype) -> np.ndarray:
    parts = [np.ascontiguousarray(np.frombuffer(p, np.uint8).reshape(dtype.itemsize, -1).T).reshape(-1).view(dtype) for p in payloads]
    return np.concatenate(parts) if parts else np.empty(0, dtype)


def doc_bucket(doc: np.ndarray, buckets: int) -> np.ndarray:
    return (mix(doc.astype(np.int64).view(np.uint64)) % U(buckets)).astype(np.int32)


def dealt(rows: np.ndarray, bucket: np.ndarray, kind: int) -> Iterator[tuple[int, int, bytes]]:
    """A row for each bucket with its part of `rows`."""
    if not len(rows):
        return
    order = np.argsort(bucket, kind="stable")
    rows, bucket = rows[order], bucket[order]
    starts = np.flatnonzero(np.diff(bucket, prepend=-1))
    for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(rows)], strict=True):
        yield int(bucket[a]), kind, packed(rows[a:b])


def batch_of(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    buckets, kinds, payloads = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(buckets, pa.int32()), pa.array(kinds, pa.int32()), pa.array(payloads, pa.binary())], names=["bucket", "kind", "payload"])


def in_batches(rows: Iterator[tuple[int, int, bytes]], most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[2])
        if size >= most:
            yield batch_of(held)
            held, size = [], 0
    if held:
        yield batch_of(held)


def runs_of(doc: int, data: np.ndarray, length: int, gram: int) -> np.ndarray:
    """All windows of a document, as runs of those with the same sampled suffix."""
    if len(data) < length:
        return np.empty(0, RUN)
    h = gram_hashes(data, gram)
    at = window_minima(h, length - gram + 1)
    lo = np.flatnonzero(np.diff(at, prepend=-1))
    n = np.diff(lo, append=len(at))
    out = np.empty(len(lo), RUN)
    out["gram"], out["region"], out["doc"] = h[at[lo]], range_hashes(data, lo, lo + n - 1 + length), doc
    out["lo"], out["n"], out["at"] = lo, n, at[lo] - lo
    return out


def first_of_class(runs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """`runs` in order of name, surroundings and place, and for each the index of the first with its name and surroundings."""
    runs = runs[np.lexsort((runs["lo"], runs["doc"], runs["region"], runs["gram"]))]
    new = np.ones(len(runs), bool)
    new[1:] = (runs["gram"][1:] != runs["gram"][:-1]) | (runs["region"][1:] != runs["region"][:-1])
    return runs, np.flatnonzero(new)[np.cumsum(new) - 1] if len(runs) else np.empty(0, np.int64)


def split_repeats(runs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first run of each class, and flags for the later ones (rows that repeat an id repeat its places, which are not later)."""
    runs, first = first_of_class(runs)
    head = first == np.arange(len(runs))
    later = ~head & ((runs["doc"] != runs["doc"][first]) | (runs["lo"] != runs["lo"][first]))
    flags = np.empty(int(later.sum()), FLAG)
    for name in FLAG.names:
        flags[name] = runs[name][later]
    return runs[head], flags


def later_windows(keys: np.ndarray, doc: np.ndarray, lo: np.ndarray) -> np.ndarray:
    """Which windows have an equal one at an earlier place."""
    order = np.lexsort((lo, doc, keys))
    k, d, p = keys[order], doc[order], lo[order]
    new = np.ones(len(k), bool)
    new[1:] = k[1:] != k[:-1]
    first = np.flatnonzero(new)[np.cumsum(new) - 1] if len(k) else np.empty(0, np.int64)
    out = np.empty(len(k), bool)
    out[order] = (d != d[first]) | (p != p[first])
    return out


def window_keys(data: np.ndarray, starts: np.ndarray, gram: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """Names of the windows at `starts` of `data`: from all their bytes, the sampled suffix's name and its offset."""
    return mix(range_hashes(data, starts, starts + length, second=True) ^ mix(gram + at.astype(np.uint64)))


def repeated(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For runs of n windows: the run of each window, and its number in the run."""
    n = n.astype(np.int64)
    owner = np.repeat(np.arange(len(n)), n)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)


def spans(covered: np.ndarray, length: int, n_bytes: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximal byte ranges covered by the windows that start where `covered` is set."""
    change = np.zeros(n_bytes + 1, np.int32)
    at = np.flatnonzero(covered)
    np.add.at(change, at, 1)
    np.add.at(change, at + length, -1)
    inside = np.concatenate([[False], np.cumsum(change[:-1]) > 0, [False]])
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    return edge[::2], edge[1::2]


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM, buckets: int | None = None) -> DataFrame:
    """One row per input row: id, n_bytes, n_removed, n_spans, kept (binary), spans (starts and ends).

    Each byte goes that lies in a string of `length` bytes which also starts earlier: in a document
    with a smaller id, or earlier in the same one. Null text is empty, a null id comes before all
    others; strings never cross documents; texts below `length` bytes lose nothing; rows that
    repeat an id share its places, so that they take nothing from each other at equal places. No
    rows give no rows; other columns are ignored. Ids must be integers.

    1. Sample and name. The cover is content-defined: of the `gram`-byte strings in a window the
       one with the smallest hash stands for it, so equal windows have equal sampled suffixes at
       equal offsets, and about one suffix in 35 is sampled. Neighbouring windows with the same
       one form a run, named by the sampled string and by all the run's text (64 bits each).
    2. Order the names. Equal ones, found within a task's block first and then by bucket, have
       equal windows: all but the first run are flagged. So a text that fills a third of the
       table sends one name per block.
    3. Merge the rest. First runs whose sampled string also stands in other surroundings fetch
       their text; their windows are named by all their bytes and compared with their neighbours
       in order of name, within a bucket of the sampled string, or for strings with more than
       LARGE surroundings within a bucket of the window's own name.
    4. Flags meet their documents by bucket of the id, and the covered bytes go.
    """
    spark = df.sparkSession
    count = buckets or max(512, 8 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    docs = df.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("doc"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("body"))

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(held: list[np.ndarray]) -> Iterator[tuple[int, int, bytes]]:
            firsts, flags = split_repeats(np.concatenate(held))
            yield from dealt(firsts, (mix(firsts["gram"]) % U(count)).astype(np.int32), RUNS)
            yield from dealt(flags, doc_bucket(flags["doc"], count), FLAGS)

        def rows() -> Iterator[tuple[int, int, bytes]]:
            held, size = [], 0
            for batch in batches:
                for doc, body in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    data = np.frombuffer(body.as_buffer(), np.uint8) if body.as_buffer().size else np.empty(0, np.uint8)
                    held.append(runs_of(doc, data, length, gram))
                    size += len(data)
                    if size >= BLOCK_BYTES:
                        yield from flush(held)
                        held, size = [], 0
            if held:
                yield from flush(held)

        yield from in_batches(rows())

    def order_names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple[int, int, bytes]]:
            held = []
            for batch in batches:
                for bucket, kind, payload in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if kind == FLAGS:
                        yield bucket, kind, payload
                    else:
                        held.append(payload)
            if not held:
                return
            firsts, flags = split_repeats(unpacked(held, RUN))
            yield from dealt(flags, doc_bucket(flags["doc"], count), FLAGS)
            _, owner, classes = np.unique(firsts["gram"], return_inverse=True, return_counts=True)
            classes = classes[owner]
            for kind, chosen in ((SEEDS, (classes > 1) & (classes <= LARGE)), (LARGE_SEEDS, classes > LARGE)):
                seeds = firsts[chosen]
                yield from dealt(seeds, doc_bucket(seeds["doc"], count), kind)

        yield from in_batches(rows())

    def fetch(key: tuple, texts: pa.Table, seeds: pa.Table) -> pa.Table:
        found = {}
        for doc, body in zip(texts.column("doc").to_pylist(), texts.column("body").to_pylist(), strict=True):
            found.setdefault(doc, []).append(body)
        rows = []
        for kind in (SEEDS, LARGE_SEEDS):
            runs = unpacked([p for k, p in zip(seeds.column("kind").to_pylist(), seeds.column("payload").to_pylist(), strict=True) if k == kind], RUN)
            runs = runs[np.argsort(runs["doc"], kind="stable")]
            regions, windows = [], []
            new = np.ones(len(runs), bool)
            new[1:] = runs["doc"][1:] != runs["doc"][:-1]
            edges = [*np.flatnonzero(new).tolist(), len(runs)]
            for a, b in zip(edges, edges[1:], strict=False):
                own = runs[a:b]
                for body in found.get(int(own["doc"][0]), ()):
                    data = np.frombuffer(body, np.uint8)
                    ends = own["lo"].astype(np.int64) + own["n"] - 1 + length
                    fits = ends <= len(data)
                    fits[fits] = range_hashes(data, own["lo"][fits].astype(np.int64), ends[fits]) == own["region"][fits]
                    if kind == SEEDS:
                        regions += [(own[i], body[own["lo"][i] : ends[i]]) for i in np.flatnonzero(fits)]
                    else:
                        picked = own[fits]
                        at_run, number = repeated(picked["n"])
                        w = np.empty(len(at_run), WINDOW)
                        starts = picked["lo"][at_run].astype(np.int64) + number
                        w["key"] = window_keys(data, starts, picked["gram"][at_run], picked["at"][at_run] - number.astype(np.int64), length)
                        w["doc"], w["lo"] = picked["doc"][at_run], starts
                        windows.append(w)
            if regions:
                heads = np.array([r for r, _ in regions], RUN)
                bucket = (mix(heads["gram"]) % U(count)).astype(np.int32)
                for b in np.unique(bucket):
                    chosen = np.flatnonzero(bucket == b)
                    head = packed(heads[chosen])
                    rows.append((int(b), REGIONS, len(head).to_bytes(4, "little") + head + b"".join(regions[i][1] for i in chosen)))
            if windows:
                w = np.concatenate(windows)
                rows += dealt(w, (w["key"] % U(count)).astype(np.int32), WINDOWS)
        return pa.Table.from_batches([batch_of(rows)] if rows else [], schema=pa.schema([("bucket", pa.int32()), ("kind", pa.int32()), ("payload", pa.binary())]))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple[int, int, bytes]]:
            regions: dict[int, list[bytes]] = {}
            windows: dict[int, list[bytes]] = {}
            for batch in batches:
                for bucket, kind, payload in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    (regions if kind == REGIONS else windows).setdefault(bucket, []).append(payload)
            for parts in windows.values():
                w = unpacked(parts, WINDOW)
                w = w[later_windows(w["key"], w["doc"], w["lo"])]
                yield from flagged(w["doc"], w["lo"])
            for parts in regions.values():
                sizes = [int.from_bytes(p[:4], "little") for p in parts]
                runs = unpacked([p[4 : 4 + n] for p, n in zip(parts, sizes, strict=True)], RUN)
                data = np.frombuffer(b"".join(p[4 + n :] for p, n in zip(parts, sizes, strict=True)), np.uint8)
                each = runs["n"].astype(np.int64) - 1 + length
                begin = np.cumsum(each) - each
                at_run, number = repeated(runs["n"])
                keys = window_keys(data, begin[at_run] + number, runs["gram"][at_run], runs["at"][at_run] - number.astype(np.int64), length)
                doc, lo = runs["doc"][at_run], runs["lo"][at_run] + number.astype(np.uint32)
                late = later_windows(keys, doc, lo)
                yield from flagged(doc[late], lo[late])

        def flagged(doc: np.ndarray, lo: np.ndarray) -> Iterator[tuple[int, int, bytes]]:
            order = np.lexsort((lo, doc))
            doc, lo = doc[order], lo[order].astype(np.int64)
            new = np.ones(len(doc), bool)
            number = np.arange(len(doc))
            new[1:] = (doc[1:] != doc[:-1]) | (lo[1:] != lo[:-1] + 1)
            new |= (number - np.maximum.accumulate(np.where(new, number, 0))) % 200 == 0
            start = np.flatnonzero(new)
            flags = np.empty(len(start), FLAG)
            flags["doc"], flags["lo"], flags["n"] = doc[start], lo[start], np.diff(start, append=len(doc))
            yield from dealt(flags, doc_bucket(flags["doc"], count), FLAGS)

        yield from in_batches(rows())

    def cut(key: tuple, texts: pa.Table, flags: pa.Table) -> pa.Table:
        marks = unpacked(flags.column("payload").to_pylist(), FLAG)
        marks = marks[np.argsort(marks["doc"], kind="stable")]
        out = []
        for doc, body in zip(texts.column("doc").to_pylist(), texts.column("body").to_pylist(), strict=True):
            a, b = np.searchsorted(marks["doc"], [doc, doc + 1]) if doc < 2**63 - 1 else (np.searchsorted(marks["doc"], doc), len(marks))
            own = marks[a:b]
            if not len(own) or len(body) < length:
                out.append((doc, len(body), 0, body, []))
                continue
            at_run, number = repeated(own["n"])
            places = own["lo"][at_run].astype(np.int64) + number
            covered = np.zeros(len(body), bool)
            covered[places[places <= len(body) - length]] = True
            starts, ends = spans(covered, length, len(body))
            edges = [0, *np.stack([starts, ends], 1).reshape(-1).tolist(), len(body)]
            kept = b"".join(body[x:y] for x, y in zip(edges[::2], edges[1::2], strict=True))
            out.append((doc, len(body), len(body) - len(kept), kept, edges[1:-1]))
        cols = list(zip(*out, strict=True)) or [[]] * 5
        types = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64())]
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["doc", "n_bytes", "n_removed", "kept", "spans"])

    # the bucket of an id, computed where the documents are read, so that both meetings share one exchange
    def with_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bucket = doc_bucket(np.asarray(batch.column(0)), count)
            yield pa.RecordBatch.from_arrays([pa.array(bucket, pa.int32()), *batch.columns], names=["bucket", "doc", "body"])

    named = checkpointed(docs.mapInArrow(sample, SCHEMA).repartition("bucket").mapInArrow(order_names, SCHEMA))
    texts = docs.mapInArrow(with_bucket, "bucket int, doc long, body binary")
    seeds = named.where(F.col("kind").isin(SEEDS, LARGE_SEEDS))
    merged = texts.groupBy("bucket").cogroup(seeds.groupBy("bucket")).applyInArrow(fetch, SCHEMA).repartition("bucket").mapInArrow(merge, SCHEMA)
    flags = named.where(F.col("kind") == FLAGS).unionByName(merged)
    result = texts.groupBy("bucket").cogroup(flags.groupBy("bucket")).applyInArrow(cut, "doc long, n_bytes long, n_removed long, kept binary, spans array<long>")
    return result.select(F.nullif("doc", F.lit(NO_ID)).alias(id_col), "n_bytes", "n_removed", (F.size("spans") / 2).cast("long").alias("n_spans"), "kept", "spans")


def brute_force(texts: dict[int, bytes], length: int = LENGTH) -> dict[int, tuple[int, int, int, str]]:
    """The same figures by a dictionary of every string, for small inputs."""
    seen: set[bytes] = set()
    out = {}
    for doc in sorted(texts):
        body = texts[doc]
        covered = np.zeros(len(body), bool)
        for i in range(len(body) - length + 1):
            s = body[i : i + length]
            if s in seen:
                covered[i] = True
            seen.add(s)
        starts, ends = spans(covered, length, len(body))
        kept = body
        for a, b in zip(starts[::-1], ends[::-1], strict=True):
            kept = kept[:a] + kept[b:]
        out[doc] = (len(body), len(body) - len(kept), len(starts), hashlib.sha256(kept).hexdigest())
    return out
