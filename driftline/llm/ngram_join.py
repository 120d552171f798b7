"""Jaccard self-join on word n-grams by chosen paths."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftline.llm.common import checkpointed, release
from driftline.llm.components import components
from driftline.llm.minimizers import P1, TABLE, U, mix

WORDS, SIMILARITY = 5, 0.8
#: Runs of the first and of the second round, and of each further one until TARGET of the merges are found by estimate.
FIRST, SECOND, FURTHER, TARGET, MOST_RUNS = 4, 12, 8, 0.999, 64
#: Tokens a set follows at each node (times 1 / size), and levels after which nodes are compared in blocks.
BRANCH, DEPTH = 1.4, 12
#: Sets of a node that is compared by brute force, sampled tokens a set carries, and the share of those that candidates have in common.
LEAF, SKETCH, ALIKE = 256, 64, 0.55
#: Sets that every part of a large node meets.
PIVOTS = 16
#: Sets and tokens of a part of a cluster; a task compares two parts exactly.
BLOCK, BLOCK_TOKENS = 1024, 400_000
#: Pairs after which a task that joins sets passes on what it has.
MOST_PAIRS = 100_000
#: Sets of a large node, about, that show which tokens most of its sets share.
SEEN = 32
NO_ID = -(2**63)
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True


def shingles(body: bytes, width: int = WORDS) -> np.ndarray:
    """Sorted hashes of the distinct `width`-word windows of a text; of all its words if they are fewer; none without words."""
    data = np.frombuffer(body, np.uint8)
    inside = ~_SPACE[data]
    edge = np.flatnonzero(np.diff(inside, prepend=False, append=False))
    starts, ends = edge[::2], edge[1::2]
    if not len(starts):
        return np.empty(0, np.uint64)
    P1.to(len(data) + 1)
    place = np.arange(len(data)) - np.repeat(starts, np.diff(starts, append=len(data))) if starts[0] == 0 else np.concatenate([np.zeros(starts[0], np.int64), np.arange(starts[0], len(data)) - np.repeat(starts, np.diff(starts, append=len(data)))])
    word = mix(np.add.reduceat(np.where(inside, TABLE[data] * P1.up[place], U(0)), starts) + (ends - starts).astype(np.uint64))
    if len(word) < width:
        out = word[:1] * U(1)
        for w in word[1:]:
            out = mix(out) + w
        return mix(out + U(len(word)))
    n = len(word) - width + 1
    out = word[:n].copy()
    for k in range(1, width):
        out = mix(out) + word[k : n + k]
    return np.unique(mix(out))


def name_of(tokens: np.ndarray) -> bytes:
    """128 bits that stand for a whole set."""
    with np.errstate(over="ignore"):
        a, b = mix(tokens).sum(dtype=np.uint64), mix(tokens ^ U(0xD6E8FEB86659FD93)).sum(dtype=np.uint64)
        return mix(np.array([a + U(len(tokens)), b], np.uint64)).tobytes()


def seeds(first: int, last: int) -> np.ndarray:
    """A random number for each run from `first` to before `last`."""
    return mix(np.arange(first + 1, last + 1, dtype=np.uint64) * U(0x9E3779B97F4A7C15))


def below(hashes: np.ndarray, share: float) -> np.ndarray:
    return hashes <= U(min(2**64 - 1, int(share * 2**64)))


def first_keys(tokens: np.ndarray, runs: np.ndarray) -> np.ndarray:
    """Nodes on the first level that a set goes to: in each run those of its tokens whose hash, the token times the run's odd number, is small for its size."""
    share = BRANCH / (SIMILARITY * len(tokens))
    spread = mix(tokens)
    return mix(np.concatenate([tokens[below(spread * (run | U(1)), share)] + run for run in runs]))


def child_keys(key: int, sketch: np.ndarray, common: np.ndarray) -> np.ndarray:
    """Nodes below `key` that a set with these sampled tokens goes to, by tokens that are not `common` to most sets of the node.

    A similar set shares SIMILARITY of the sketch with it, and so at least what is left of that without the common ones.
    """
    own = np.setdiff1d(sketch, common, assume_unique=True)
    shared = max(SIMILARITY * len(sketch) - (len(sketch) - len(own)), 0.1 * len(sketch))
    at = mix(own.astype(np.uint64) + U(key % 2**64))
    return mix(at[below(at, BRANCH / shared)] ^ U(0x94D049BB133111EB))


def common_tokens(shorts: list[bytes]) -> np.ndarray:
    """Tokens in at least half of these sketches."""
    values, times = np.unique(np.concatenate([np.frombuffer(s, np.uint16) for s in shorts]), return_counts=True)
    return values[2 * times >= max(len(shorts), 3)]


def sketch_of(tokens: np.ndarray) -> np.ndarray:
    """The SKETCH tokens that come first in one fixed random order, as their places in it."""
    places = (mix(tokens ^ U(0x2545F4914F6CDD1D)) >> U(32)).astype(np.uint32)
    return np.sort(np.partition(places, SKETCH)[:SKETCH] if len(places) > SKETCH else places)


def short_of(tokens: np.ndarray) -> bytes:
    """16 bits of each sampled token."""
    return np.unique(sketch_of(tokens).astype(np.uint16)).tobytes()


def in_common(rows: list[np.ndarray], others: list[np.ndarray] | None = None) -> np.ndarray:
    """Numbers of common values of each row with each of the others."""
    both = rows if others is None else [*rows, *others]
    values, inverse, times = np.unique(np.concatenate(both), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(both)), [len(r) for r in both])
    n, m = len(rows), len(both) - len(rows) if others is not None else len(rows)
    total = np.zeros((n, m), np.float32)
    if others is None:
        total[np.arange(n), np.arange(n)] = [len(r) for r in rows]
    shared = times > 1  # what one row alone has is common to no two
    kept = shared[inverse]
    inverse, owner = (np.cumsum(shared) - 1)[inverse[kept]], owner[kept]
    if others is None and len(inverse):
        total[np.arange(n), np.arange(n)] -= np.bincount(owner, minlength=n)
    order = np.argsort(inverse, kind="stable")
    inverse, owner = inverse[order], owner[order]
    width = 2048
    for at in range(0, int(shared.sum()), width):
        a, b = np.searchsorted(inverse, [at, at + width])
        x = np.zeros((len(both), width), np.float32)
        x[owner[a:b], inverse[a:b] - at] = 1
        total += x[:n] @ (x if others is None else x[n:]).T
    return total


def merged(pairs: Iterable[tuple[int, int]], n: int) -> tuple[list[int], list[tuple[int, int]]]:
    """For each of n the least of what the pairs connect it to, and those of the pairs that span that."""
    root = list(range(n))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = i = root[root[i]]
        return i

    kept = []
    for a, b in pairs:
        x, y = find(a), find(b)
        if x != y:
            root[max(x, y)] = min(x, y)
            kept.append((a, b))
    return [find(i) for i in range(n)], kept


def roots_of(pairs: Iterable[tuple[int, int]], n: int) -> list[int]:
    return merged(pairs, n)[0]


def forest(pairs: Iterable[tuple[int, int]], n: int) -> list[tuple[int, int]]:
    return merged(pairs, n)[1]


def grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, list[tuple]]]:
    """Rows by their first column, of a partition sorted by it."""
    rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))
    for key, group in groupby(rows, lambda r: r[0]):
        yield key, list(group)


def tables(rows: Iterator[tuple], schema: pa.Schema, most: int = 20_000, most_bytes: int = 1 << 23) -> Iterator[pa.RecordBatch]:
    """Batches of up to `most` rows or about `most_bytes` of their last column."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[-1]) if isinstance(row[-1], bytes) else 0
        if len(held) >= most or size >= most_bytes:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), schema.types, strict=True)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), schema.types, strict=True)], schema=schema)


def read_sets(docs: DataFrame, digests: bool = False) -> DataFrame:
    """doc, name (of its set), keys (of the first two rounds), early (how many of them are the first round's), tokens (how many the set has), short (16 bits of the sampled tokens), and if wanted digest (SHA-256 of the text) of each document."""
    early, late = seeds(0, FIRST), seeds(FIRST, FIRST + SECOND)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc", pa.int64()), ("name", pa.binary()), ("early", pa.int32()), ("keys", pa.list_(pa.int64())), ("tokens", pa.int32()), ("short", pa.binary()), *([("digest", pa.binary())] if digests else [])])

        def rows() -> Iterator[tuple]:
            for batch in batches:
                for doc, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    t = shingles(body)
                    more = (hashlib.sha256(body).digest(),) if digests else ()
                    if len(t):
                        first = first_keys(t, early)
                        yield doc, name_of(t), len(first), np.concatenate([first, first_keys(t, late)]).view(np.int64), len(t), short_of(t), *more
                    else:
                        yield doc, None, 0, [], 0, None, *more

        yield from tables(rows(), schema, 2000)

    return docs.mapInArrow(run, "doc long, name binary, early int, keys array<long>, tokens int, short binary" + ", digest binary" * digests)


def further_keys(docs: DataFrame, first: int, last: int) -> DataFrame:
    """id, keys of the runs from `first` to before `last`, of each document with a set."""
    runs = seeds(first, last)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for batch in batches:
                for body in batch.column(0).to_pylist():
                    t = shingles(body)
                    if len(t):
                        yield int.from_bytes(name_of(t)[:8], "big", signed=True), first_keys(t, runs).view(np.int64)

        yield from tables(rows(), pa.schema([("id", pa.int64()), ("keys", pa.list_(pa.int64()))]), 2000)

    return docs.select("body").mapInArrow(run, "id long, keys array<long>")


def may_link(common: np.ndarray, sampled: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    """Which sets may have SIMILARITY, by how many sampled tokens each two have `common`, how many different 16 bits of them each has, and how many tokens its set has.

    Sizes that differ too much rule a pair out. Sets of up to SKETCH tokens are sampled whole, so they must have in
    common what the similarity asks for, less what either lost to equal 16 bits; of larger ones ALIKE of the sample.
    """
    a, b = tokens[:, None], tokens[None, :]
    lost = np.minimum(tokens, SKETCH) - sampled
    asked = SIMILARITY / (1 + SIMILARITY) * (a + b) - np.minimum(lost[:, None], lost)
    asked = np.where(np.maximum(a, b) <= SKETCH, asked, ALIKE * np.minimum(sampled[:, None], sampled))
    return (common >= asked - 1e-6) & (np.minimum(a, b) >= SIMILARITY * np.maximum(a, b) - 1e-6)


def leaf_edges(groups: DataFrame) -> DataFrame:
    """a, b: sets of a group that seem alike, as few pairs as connect those of a task. groups: task, id, short, tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def told(number: dict[int, int], joined: list[tuple[int, int]]) -> Iterator[tuple]:
            # the edges all point to the least of what they connect, which saves rounds later
            ids = sorted(number)
            place = {number[x]: i for i, x in enumerate(ids)}
            for i, root in enumerate(roots_of([(place[x], place[y]) for x, y in joined], len(ids))):
                if root != i:
                    yield ids[i], ids[root]

        def rows() -> Iterator[tuple]:
            number: dict[int, int] = {}
            joined: list[tuple[int, int]] = []
            for _, group in grouped(batches):
                if len(group) < 2:
                    continue
                shorts = [np.frombuffer(r[2], np.uint16) for r in group]
                if len(group) < 6:
                    sets = [set(s.tolist()) for s in shorts]
                    common = np.array([[len(x & y) for y in sets] for x in sets])
                else:
                    common = in_common(shorts)
                pairs = np.argwhere(np.triu(may_link(common, np.array([len(s) for s in shorts]), np.array([r[3] for r in group])), 1)).tolist()
                for pair in forest(pairs, len(group)):
                    joined.append(tuple(number.setdefault(group[k][1], len(number)) for k in pair))
                if len(joined) >= MOST_PAIRS:
                    yield from told(number, joined)
                    number, joined = {}, []
            yield from told(number, joined)

        yield from tables(rows(), pa.schema([("a", pa.int64()), ("b", pa.int64())]))

    return groups.select("task", "id", "short", "tokens").repartition("task").sortWithinPartitions("task").mapInArrow(run, "a long, b long")


def children(large: DataFrame) -> DataFrame:
    """id, cluster, tokens, short, key: the nodes below that the sets of large nodes go to. large: id, cluster, tokens, short, key, n.

    What most sets of a node share does not part them; a sample of about SEEN sets a node tells which tokens these are.
    """

    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            common = [common_tokens(seen).tobytes() for seen in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(common, pa.binary())], names=["key", "common"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for batch in batches:
                for own, cluster, key, tokens, short, common in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    for child in child_keys(key, np.frombuffer(short, np.uint16), np.frombuffer(common or b"", np.uint16)).view(np.int64).tolist():
                        yield own, cluster, tokens, short, child

        yield from tables(rows(), pa.schema([("id", pa.int64()), ("cluster", pa.int64()), ("tokens", pa.int32()), ("short", pa.binary()), ("key", pa.int64())]), 5000)

    sampled = large.where(F.pmod(F.xxhash64("id", "key"), F.greatest((F.col("n") / SEEN).cast("long"), F.lit(1))) == 0)
    common = sampled.groupBy("key").agg(F.collect_list("short").alias("seen")).mapInArrow(shared, "key long, common binary")
    return large.join(common, "key", "left").select("id", "cluster", "key", "tokens", "short", "common").mapInArrow(run, "id long, cluster long, tokens int, short binary, key long")


def nodes_of(level: DataFrame) -> DataFrame:
    """key, n of the nodes whose sets are not all in one cluster; of nodes that hold the same sets one. level: id, cluster, key."""
    every = level.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.bit_xor("id").alias("x"), F.min("cluster").alias("low"), F.max("cluster").alias("high")).where("low < high")
    return checkpointed(every.groupBy("n", "x").agg(F.min("key").alias("key")).select("key", "n"))


def parts_of(rows: DataFrame, everywhere: Column) -> DataFrame:
    """task, id, short, tokens: the sets of a node, LEAF to a part; those with `everywhere` go to each part. rows: key, n, id, short, tokens."""
    parts = F.ceil(F.col("n") / LEAF).cast("int")
    own = F.pmod(F.xxhash64("id", "key"), parts).cast("int")
    to = F.when(parts <= 1, F.array(F.lit(0))).when(everywhere, F.sequence(F.lit(0), parts - 1)).otherwise(F.array(own))
    return rows.select("key", "id", "short", "tokens", F.explode(to).alias("part")).select(F.xxhash64("key", "part").alias("task"), "id", "short", "tokens")


def early_edges(level: DataFrame, shorts: DataFrame) -> DataFrame:
    """a, b of the first round: in parts of LEAF sets, each with the same PIVOTS, so that what is much alike becomes one cluster."""
    rows = level.join(nodes_of(level), "key").join(shorts, "id")
    pivot = F.pmod(F.xxhash64("key", "id"), F.greatest((F.col("n") / PIVOTS).cast("long"), F.lit(1))) == 0
    return checkpointed(leaf_edges(parts_of(rows, pivot)))


def late_edges(level: DataFrame, shorts: DataFrame) -> list[DataFrame]:
    """a, b of a later round, level by level down to nodes whose sets outside one cluster are LEAF at most; those meet all."""
    found = []
    with_short = lambda rows: rows if "short" in rows.columns else rows.join(shorts, "id")
    for depth in range(1, DEPTH + 1):
        nodes = nodes_of(level)
        groups = parts_of(with_short(level.join(nodes.where(F.col("n") <= LEAF), "key")), F.lit(False))
        big = nodes.where(F.col("n") > LEAF)
        if big.isEmpty():
            found.append(checkpointed(leaf_edges(groups)))
            break
        shares = level.join(big, "key", "left_semi").groupBy("key", "cluster").agg(F.count(F.lit(1)).alias("m"))
        main = shares.groupBy("key").agg(F.sum("m").alias("n"), F.max(F.struct("m", "cluster")).alias("main"))
        large = checkpointed(with_short(level.join(main.select("key", "n", "main.m", F.col("main.cluster").alias("most")), "key")))
        few = large.where(F.col("n") - F.col("m") <= LEAF)
        groups = groups.unionByName(parts_of(few, F.col("cluster") != F.col("most")))
        rest = large.where(F.col("n") - F.col("m") > LEAF)
        if depth == DEPTH:
            groups = groups.unionByName(block_pairs(rest))
        found.append(checkpointed(leaf_edges(groups)))
        release(level.sparkSession)
        if rest.isEmpty():
            break
        level = checkpointed(children(rest))
        release(level.sparkSession)
    return found


def block_pairs(rows: DataFrame) -> DataFrame:
    """task, id, short, tokens: nodes that splitting does not part; every two blocks of half a LEAF meet in a task. rows: key, n, id, short, tokens."""
    blocks = F.ceil(2 * F.col("n") / LEAF).cast("int")
    own = F.pmod(F.xxhash64("id", "key"), blocks).cast("int")
    rows = rows.select("key", "id", "short", "tokens", own.alias("own"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("other"))
    return rows.select(F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")).alias("task"), "id", "short", "tokens")


def merges(clusters: DataFrame) -> int:
    return clusters.where("node <> root").count()


def candidate_clusters(sets: DataFrame, docs: DataFrame) -> DataFrame:
    """node, root: sets that may be similar, directly or by others between. sets: id, keys, early, tokens, short, a row for each different set."""
    shorts = sets.select("id", "short", "tokens")
    first = sets.select("id", F.col("id").alias("cluster"), F.explode(F.slice("keys", F.lit(1), F.col("early"))).alias("key"))
    edges = early_edges(first, shorts)
    # equal roots are one cluster; those not yet merged may cost work later, but no result
    clusters = components(edges, 2, settle=False)
    keys, done, runs = sets.select("id", F.slice("keys", F.col("early") + 1, F.greatest(F.size("keys") - F.col("early"), F.lit(0))).alias("keys")), FIRST, SECOND
    while True:
        known = keys.join(clusters.withColumnRenamed("node", "id"), "id", "left")
        level = known.select("id", F.coalesce("root", "id").alias("cluster"), F.explode("keys").alias("key"))
        for more in late_edges(level, shorts):
            edges = edges.unionByName(more)
        before, clusters = merges(clusters), components(edges)
        release(docs.sparkSession)
        missed = 1 - before / max(merges(clusters), 1)  # what all runs before this round did not find
        if missed ** ((done + runs) / done) <= 1 - TARGET or done + runs >= MOST_RUNS:
            return clusters
        done, runs = done + runs, FURTHER
        keys = further_keys(docs, done, done + runs).groupBy("id").agg(F.first("keys").alias("keys"))


def compare(left: list[np.ndarray], right: list[np.ndarray] | None, similarity: float) -> np.ndarray:
    """Whether each two sets have at least that Jaccard similarity, exactly; without `right` those of `left`, a set with itself not."""
    other = left if right is None else right
    a, b = np.array([len(t) for t in left]), np.array([len(t) for t in other])
    need = similarity / (1 + similarity) * (a[:, None] + b) - 1e-6
    may = np.minimum(a[:, None], b) >= need
    if right is None:
        np.fill_diagonal(may, False)
    pairs = np.argwhere(np.triu(may) if right is None else may)
    if len(pairs) > 64:
        return may & (in_common(left, right) >= need)
    for i, j in pairs:
        may[i, j] = len(np.intersect1d(left[i], other[j], assume_unique=True)) >= need[i, j]
        if right is None:
            may[j, i] = may[i, j]
    return may


def spanning(linked: np.ndarray) -> list[tuple[int, int]]:
    """As few pairs as connect what a symmetric matrix links."""
    kept, fresh = [], np.ones(len(linked), bool)
    for first in range(len(linked)):
        ahead = [first] if fresh[first] else []
        fresh[first] = False
        while ahead:
            i = ahead.pop()
            found = np.flatnonzero(linked[i] & fresh)
            fresh[found] = False
            ahead += found.tolist()
            kept += [(i, int(j)) for j in found]
    return kept


def compare_texts(rows: DataFrame, similarity: float) -> DataFrame:
    """a, b, links: for each set a how many rows a task links it to (b null), and pairs that span what those links connect (links null). rows: body, name, copies, to (tasks and sides).

    In a task each set on side 0 meets each on side 1, and those on side 2 meet each other.
    """

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("task", pa.int64()), ("side", pa.int32()), ("name", pa.binary()), ("copies", pa.int64()), ("tokens", pa.binary())])

        def rows() -> Iterator[tuple]:
            for batch in batches:
                for body, name, copies, to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    t = shingles(body)
                    if not len(t) or name_of(t) != name:
                        continue
                    raw = t.astype("<u8").view(np.uint8).reshape(-1, 8)[:, 2:].tobytes()  # 48 of 64 bits
                    for x in to:
                        yield x["task"], x["side"], name, copies, raw

        yield from tables(rows(), schema, 500)

    def brute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def tokens(raw: bytes) -> np.ndarray:
            wide = np.zeros((len(raw) // 6, 8), np.uint8)
            wide[:, :6] = np.frombuffer(raw, np.uint8).reshape(-1, 6)
            return np.sort(wide.view("<u8").reshape(-1))

        def told(names: list[bytes], copies: np.ndarray, linked: np.ndarray) -> Iterator[tuple]:
            for i, j in spanning(linked):
                yield names[i], names[j], None
            for i in np.flatnonzero(linked.any(1)):
                yield names[i], None, int(copies[linked[i]].sum())

        def rows() -> Iterator[tuple]:
            every = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))
            for _, group in groupby(every, lambda r: r[0]):
                sides: list[dict[bytes, tuple[int, bytes]]] = [{}, {}, {}]
                for _, side, name, copies, raw in group:
                    sides[side][name] = copies, raw  # rows that repeat an id and a text are one set
                meet, own = [*sides[0], *sides[1]], list(sides[2])
                if len(own) > 1:
                    yield from told(own, np.array([c for c, _ in sides[2].values()]), compare([tokens(r) for _, r in sides[2].values()], None, similarity))
                if sides[0] and sides[1]:
                    n, linked = len(sides[0]), np.zeros((len(meet), len(meet)), bool)
                    linked[:n, n:] = compare(*([tokens(r) for _, r in side.values()] for side in sides[:2]), similarity)
                    linked[n:, :n] = linked[:n, n:].T
                    yield from told(meet, np.array([c for side in sides[:2] for c, _ in side.values()]), linked)

        yield from tables(rows(), pa.schema([("a", pa.binary()), ("b", pa.binary()), ("links", pa.int64())]))

    tasks = rows.select("body", "name", "copies", "to").mapInArrow(fetch, "task long, side int, name binary, copies long, tokens binary")
    return checkpointed(tasks.repartition("task").sortWithinPartitions("task").mapInArrow(brute, "a binary, b binary, links long"))


def links_of(members: DataFrame, docs: DataFrame, similarity: float) -> DataFrame:
    """a, b, links (see compare_texts) of all pairs of sets of a cluster. members: name, doc, copies, tokens, cluster.

    A cluster is cut into parts of about BLOCK sets or BLOCK_TOKENS tokens, and every two parts, and
    each part with itself, are a task: exact, bounded in memory, and in work the square of a cluster.
    """
    sizes = members.groupBy("cluster").agg(F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK), F.ceil(F.sum("tokens") / BLOCK_TOKENS)).cast("int").alias("parts"))
    own = F.pmod(F.xxhash64("name"), F.col("parts")).cast("int")
    task = lambda p: F.xxhash64("cluster", F.least("own", p), F.greatest("own", p)).alias("task")
    side = lambda p: F.when(p == F.col("own"), 2).when(p > F.col("own"), 0).otherwise(1).alias("side")
    to = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda p: F.struct(task(p), side(p)))
    placed = members.join(sizes, "cluster").withColumn("own", own).select("name", "doc", "copies", to.alias("to"))
    found = compare_texts(docs.join(placed, "doc"), similarity)
    release(docs.sparkSession)
    return found


def ngram_join(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY, digests: bool = False) -> DataFrame:
    """One row per input row: id, class_id, class_rows, n_links, n_copies; if wanted digest (SHA-256 of the text) and root (a name of the class, null for a row alone in its own).

    Sets are the distinct 5-word windows of a text's words; fewer words are one window; texts
    without words (null, empty) have no set, no links and are classes by themselves. Two rows are
    linked if their sets have at least that Jaccard similarity; a class is what links connect,
    so rows of different classes have none, and class_id is the least id of its class_rows rows. n_links
    is the number of other rows that a row is linked to, each compared exactly, among them its n_copies with an equal set. A null id counts as smaller than all; rows that repeat are linked to each
    other; no rows give no rows; other columns are ignored. Ids must be integers.

    1. Equal sets become one (by 128-bit names, aggregated map-side).
    2. Chosen paths: in each run a set goes to the nodes of those tokens whose hash is below
       BRANCH / (similarity * size), so similar sets share some node. Small nodes compare
       sampled tokens by brute force. The first round's runs only join what is much alike
       to clusters, large nodes in parts that share a few pivots. From then on a node whose sets
       are all in one cluster has nothing to tell and goes no deeper, so groups of copies of any size do
       not multiply; one with at most LEAF sets outside a cluster compares those with all; the
       others are split again by sampled tokens (and by blocks, exactly, should DEPTH levels not part them).
    3. Rounds of runs are repeated until the share of merges that the rounds before had missed
       says that TARGET of them are found; this is measured in the tests.
    4. Within the clusters all links are found exactly and counted (see links_of), and their components are the classes.
    """
    docs = df.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("doc"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("body"))
    rows = checkpointed(read_sets(docs, digests))
    number = F.conv(F.hex(F.substring("name", 1, 8)), 16, -10).cast("long")
    sets = rows.where("name IS NOT NULL").groupBy("name").agg(F.min("doc").alias("doc"), F.count(F.lit(1)).alias("copies"), *[F.first(c).alias(c) for c in ("early", "keys", "tokens", "short")])
    sets = checkpointed(sets.select("*", number.alias("id")))
    release(df.sparkSession)
    clusters = candidate_clusters(sets, docs)
    members = clusters.select(F.col("node").alias("id"), F.col("root").alias("cluster")).join(sets.select("id", "name", "doc", "copies", "tokens"), "id")
    found = links_of(checkpointed(members.select("name", "doc", "copies", "tokens", "cluster")), docs, similarity)
    classes = components(found.where("b IS NOT NULL").select("a", "b"))
    release(docs.sparkSession)
    counts = found.where("links > 0").groupBy(F.col("a").alias("name")).agg(F.sum("links").alias("links"))

    known = sets.select("name", "doc", "copies").join(counts, "name", "left").join(classes.withColumnRenamed("node", "name"), "name", "left")
    known = known.select("name", "doc", "copies", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("root", "name").alias("root"))
    known = checkpointed(known.where("copies > 1 OR links > 0"))
    release(df.sparkSession)
    least = known.groupBy("root").agg(F.min("doc").alias("class"), F.sum("copies").alias("rows"))
    known = known.join(least, "root").select("name", "class", "rows", "copies", "links", *["root"] * digests)
    salts = 32
    salted = known.select("*", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    out = rows.select("doc", "name", F.pmod(F.xxhash64("doc"), F.lit(salts)).cast("int").alias("salt"), *["digest"] * digests).join(salted, ["name", "salt"], "left")
    return out.select(
        F.nullif("doc", F.lit(NO_ID)).alias(id_col),
        F.nullif(F.coalesce("class", "doc"), F.lit(NO_ID)).alias("class_id"),
        F.coalesce("rows", F.lit(1)).alias("class_rows"),
        (F.coalesce("links", F.lit(0)) + F.coalesce("copies", F.lit(1)) - 1).alias("n_links"),
        (F.coalesce("copies", F.lit(1)) - 1).alias("n_copies"),
        *["digest", "root"] * digests,
    )
