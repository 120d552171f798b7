"""Ranked lexical search over a two-level quantised index.

The index has a row a document: level one holds a byte for each of its terms, its impact without
the term's weight, rounded up; level two holds what the exact score needs, occurrences and length.
A search reads level one to bound every document's score from both sides, takes the k-th largest
lower bound of each item over all documents, and scores exactly, in integers, every document
whose upper bound reaches it. So no document that belongs to an item's best k can be lost.
"""

from __future__ import annotations

import math
import uuid
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from driftline.llm.common import LOWER, UPPER, checkpointed, shared_folder
from driftline.session import remove

#: A byte of level one counts units of this size of an impact, which is below 1,000,000.
UNIT = 4096
#: Items and terms of a block: each block is one search over the whole table.
BLOCK_ITEMS, BLOCK_TERMS = 2_000, 200_000
#: Additions a worker holds at once.
STEP = 2_000_000
#: Parts in which the best of an item are cut before they meet.
PARTS = 64

#: A-Z become lower case, other ASCII characters than letters and digits become spaces; bytes of other characters stay.
FOLD = bytes((b + 32 if 65 <= b <= 90 else b) if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def terms(text: bytes | None) -> list[bytes]:
    """Terms of a UTF-8 text; null has none."""
    return (text or b"").translate(FOLD).split(b" ") if text else []


def weight(n_docs: int, df: int) -> int:
    """A term's weight."""
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


class Items:
    """A block of items: their terms' numbers, and for each term the items that hold it, with how often."""

    def __init__(self, texts: list[bytes]):
        counts = [Counter(t for t in terms(text) if t) for text in texts]
        self.size = len(texts)
        self.most = max(map(len, counts), default=0)
        self.ids = {t: i for i, t in enumerate(sorted({t for c in counts for t in c}))}
        holds: list[list[tuple[int, int]]] = [[] for _ in self.ids]
        for item, c in enumerate(counts):
            for t, often in c.items():
                holds[self.ids[t]].append((item, often))
        self.start = np.cumsum([0, *map(len, holds)]).astype(np.int64)
        self.item = np.array([i for h in holds for i, _ in h], np.int64)
        self.often = np.array([o for h in holds for _, o in h], np.int64)


def impacts(tf: np.ndarray, n: np.ndarray, n_docs: int, total: int) -> np.ndarray:
    """Exact impacts of occurrences `tf` in documents of `n` terms, without the terms' weights."""
    m = 75 + 25 * n * n_docs // total
    return 1_000_000_000 * tf // (1000 * tf + 12 * m)


def postings_of(items: Items):
    """A function from batches of (row, id, body) to (row, id, n, terms, tfs), with the terms of `items` only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, ident, body = batch.columns
            n, size, found, tfs = [], [], [], []
            for text in body.cast(pa.binary()):
                words = terms(text.as_py())
                n.append(len(words) - words.count(b""))
                held = Counter(map(items.ids.get, words))
                held.pop(None, None)
                size.append(len(held))
                found += held.keys()
                tfs += held.values()
            offsets = pa.array(np.cumsum([0, *size]).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [row, ident, pa.array(n, pa.int64()), pa.ListArray.from_arrays(offsets, pa.array(found, pa.int32())), pa.ListArray.from_arrays(offsets, pa.array(tfs, pa.int32()))],
                names=["row", "id", "n", "terms", "tfs"],
            )

    return run


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Sizes and values of a column of lists."""
    sizes = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    return sizes, column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)


def quantised(n_docs: int, total: int):
    """A function from batches of postings to the same with level one: a byte a term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, tf = flat(batch.column("tfs"))
            n = np.repeat(batch.column("n").to_numpy().astype(np.int64), sizes)
            up = (-(-impacts(tf, n, n_docs, total) // UNIT)).astype(np.uint8).tobytes()
            ends = np.cumsum(sizes)
            levels = pa.array([up[a:b] for a, b in zip(ends - sizes, ends, strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, levels], names=[*batch.schema.names, "level"])

    return run


class Scorer:
    """Sums over the terms of documents for each item of a block, document by document, in bounded steps."""

    def __init__(self, items: Items, weights: np.ndarray):
        self.items = items
        self.weights = weights
        self.fan = np.diff(items.start)

    def steps(self, sizes: np.ndarray, found: np.ndarray) -> Iterator[tuple[int, int, int, int, np.ndarray, np.ndarray, np.ndarray]]:
        """Runs of documents: first, end, first posting, its end, and of each addition the posting, the cell (document, item) and the weight."""
        ends = np.cumsum(sizes)
        work = np.add.reduceat(np.append(self.fan[found], 0), np.minimum(ends - sizes, len(found))) * (sizes > 0) + self.items.size
        upto = np.cumsum(work)
        a = 0
        while a < len(sizes):
            b = max(a + 1, int(np.searchsorted(upto, (upto[a - 1] if a else 0) + STEP, "right")))
            first, end = int(ends[a] - sizes[a]), int(ends[b - 1])
            here = found[first:end]
            fan = self.fan[here]
            posting = np.repeat(np.arange(len(here)), fan)
            at = np.arange(len(posting)) - np.repeat(np.cumsum(fan) - fan, fan) + np.repeat(self.items.start[here], fan)
            doc = np.repeat(np.arange(b - a), sizes[a:b])
            cell = doc[posting] * self.items.size + self.items.item[at]
            yield a, b, first, end, posting, cell, self.items.often[at] * self.weights[here][posting]
            a = b

    def summed(self, cell: np.ndarray, values: np.ndarray, docs: int) -> np.ndarray:
        """Exact sums a document and item; in one call if none can leave a float's exact range."""
        cells = docs * self.items.size
        if not len(values) or float(np.abs(values).max()) * self.items.most < 2**53:
            return np.bincount(cell, weights=values, minlength=cells).astype(np.int64).reshape(docs, -1)
        out = np.zeros(cells, np.int64)
        np.add.at(out, cell, values)
        return out.reshape(docs, -1)


def lower_bounds(scorer: Scorer, k: int):
    """A function from level one to (item, lower): of each item the k largest lower bounds of a task's documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = np.zeros((k, scorer.items.size), np.int64)
        for batch in batches:
            sizes, found = flat(batch.column("terms"))
            level = np.frombuffer(b"".join(batch.column("level").to_pylist()), np.uint8).astype(np.int64)
            for a, b, first, end, posting, cell, w in scorer.steps(sizes, found):
                low = UNIT * scorer.summed(cell, w * (level[first:end][posting] - 1), b - a)
                low = np.concatenate([best, low])
                best = np.partition(low, len(low) - k, axis=0)[-k:]
        item = np.tile(np.arange(scorer.items.size), k)
        held = best.ravel() > 0
        yield pa.RecordBatch.from_arrays([pa.array(item[held], pa.int32()), pa.array(best.ravel()[held], pa.int64())], names=["item", "value"])

    return run


def exact_best(scorer: Scorer, least: np.ndarray, k: int, n_docs: int, total: int):
    """A function from the index to (item, row, id, value): of each item a task's k best documents by exact score, of those whose upper bound reaches `least`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[list[tuple]] = [[] for _ in range(scorer.items.size)]
        for batch in batches:
            sizes, found = flat(batch.column("terms"))
            _, tf = flat(batch.column("tfs"))
            level = np.frombuffer(b"".join(batch.column("level").to_pylist()), np.uint8).astype(np.int64)
            n, row, ident = batch.column("n").to_numpy().astype(np.int64), batch.column("row").to_numpy(), batch.column("id")
            for a, b, first, end, posting, cell, w in scorer.steps(sizes, found):
                up = UNIT * scorer.summed(cell, w * level[first:end][posting], b - a)
                reach = (up >= least) & (up > 0)
                held = reach.ravel()[cell]
                if not held.any():
                    continue
                exact = impacts(tf[first:end], np.repeat(n[a:b], sizes[a:b]), n_docs, total)
                score = scorer.summed(cell[held], w[held] * exact[posting[held]], b - a)
                for item in np.unique(np.nonzero(reach)[1]):
                    docs = np.nonzero(reach[:, item] & (score[:, item] > 0))[0]
                    found_here = [(-int(score[d, item]), i is None, i if i is not None else 0, int(row[a + d])) for d, i in zip(docs, (ident[a + int(d)].as_py() for d in docs), strict=True)]
                    kept[item] = sorted(kept[item] + found_here)[:k]
        flat_kept = [(item, r, None if null else i, -s) for item, rows in enumerate(kept) for s, null, i, r in rows]
        yield pa.RecordBatch.from_arrays([pa.array([x[j] for x in flat_kept], t) for j, t in enumerate((pa.int32(), pa.int64(), pa.int64(), pa.int64()))], names=["item", "row", "id", "value"])

    return run


def first_of(rows: DataFrame, k: int, *order) -> DataFrame:
    """Of each item the first `k` rows and their place; cut in parts first, so that what many tasks found never meets whole."""
    parts = rows.withColumn("part", F.spark_partition_id() % PARTS)
    for keys in (["item", "part"], ["item"]):
        parts = parts.drop("place").withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("place") <= k)
    return parts.drop("part")


def blocks_of(items: DataFrame, item_col: str, text_col: str) -> Iterator[tuple[list, list[bytes]]]:
    """Items in blocks of bounded numbers of items and terms, each read from a partition at a time."""
    ids, texts, size = [], [], 0
    for r in items.select(F.col(item_col).alias("i"), F.col(text_col).cast("binary").alias("t")).toLocalIterator():
        text = bytes(r["t"] or b"")
        n = len(terms(text))
        if ids and (len(ids) == BLOCK_ITEMS or size + n > BLOCK_TERMS):
            yield ids, texts
            ids, texts, size = [], [], 0
        ids.append(r["i"])
        texts.append(text)
        size += n
    if ids:
        yield ids, texts


def search_block(docs: DataFrame, items: Items, k: int, folder: str) -> DataFrame:
    """item (number in the block), rank, row, id, value of the best `k` documents of each item of one block."""
    spark = docs.sparkSession
    docs.mapInArrow(postings_of(items), "row long, id long, n long, terms array<int>, tfs array<int>").write.parquet(f"{folder}/postings")
    postings = spark.read.parquet(f"{folder}/postings")
    total = postings.where("n > 0").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("n"), F.lit(1)).alias("l")).first()
    df = np.zeros(len(items.ids), np.int64)
    for term, n in postings.select(F.explode("terms").alias("term")).groupBy("term").count().collect():  # a row a term of the block at most
        df[term] = n
    weights = np.array([weight(total["n"], int(x)) for x in df], np.int64)
    postings.mapInArrow(quantised(total["n"], total["l"]), "row long, id long, n long, terms array<int>, tfs array<int>, level binary").write.parquet(f"{folder}/index")
    index = spark.read.parquet(f"{folder}/index")
    remove(spark, f"{folder}/postings")
    scorer = Scorer(items, weights)
    lower = first_of(index.select("terms", "level").mapInArrow(lower_bounds(scorer, k), "item int, value long"), k, F.desc("value"))
    least = np.zeros(items.size, np.int64)
    for item, value in lower.where(F.col("place") == k).select("item", "value").collect():  # a row an item of the block at most
        least[item] = value
    found = index.mapInArrow(exact_best(scorer, least, k, total["n"], total["l"]), "item int, row long, id long, value long")
    best = checkpointed(first_of(found, k, F.desc("value"), F.asc_nulls_last("id"), "row").withColumnRenamed("place", "rank"))
    remove(spark, folder)
    return best


def lexical_search(docs: DataFrame, items: DataFrame, k: int = 20, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """item_id, rank, doc_id, score of the `k` best of all documents for each item, scores above 0 only.

    The items are the stated queries; they are taken in blocks, each one search over all documents,
    whose index (of that block's terms) is written to the shared folder. What reaches the driver is
    a block's items, a count for each of their terms and a bound for each item; a task holds `k`
    documents an item. Every row of either table counts as a document or an item of its own:
    repeated items each get their rows, repeated documents each their place, equal scores by
    ascending id, null ids last. Null and empty texts have no terms: such items get no rows, such
    documents are in no count. Empty tables give no rows; other columns play no part.
    """
    spark: SparkSession = docs.sparkSession
    schema = f"item_id {items.schema[item_col].dataType.simpleString()}, rank int, doc_id long, score long"
    numbered = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("body"))
    found = []
    for ids, texts in blocks_of(items, item_col, item_text_col):
        block = Items(texts)
        if not block.ids:
            continue
        best = search_block(numbered, block, k, f"{shared_folder(spark)}/lexical-{uuid.uuid4().hex}")
        names = spark.createDataFrame(list(enumerate(ids)), f"item int, item_id {items.schema[item_col].dataType.simpleString()}")
        found.append(best.join(F.broadcast(names), "item").select("item_id", "rank", F.col("id").alias("doc_id"), F.col("value").alias("score")))
    return reduce(DataFrame.unionByName, found) if found else spark.createDataFrame([], schema)


TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
ORACLE_SQL = rf"""
WITH d AS (SELECT doc_id, row_number() OVER () AS row, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{TERM}') AS terms FROM documents),
t AS (SELECT row, doc_id, len(terms) AS n, unnest(terms) AS term FROM d),
p AS (SELECT row, doc_id, n, term, count(*) AS tf FROM t GROUP BY ALL),
q AS (SELECT item, item_id, term, count(*) AS often FROM (
  SELECT row_number() OVER () AS item, item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{TERM}')) AS term FROM benchmark) GROUP BY ALL),
s AS (SELECT count(*)::BIGINT AS n_docs, sum(len(terms))::BIGINT AS total FROM d WHERE len(terms) > 0),
w AS (SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM p, s GROUP BY term, n_docs),
r AS (SELECT item, item_id, row, doc_id, sum(often * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * n_docs) // total))))::BIGINT AS score
      FROM q JOIN p USING (term) JOIN w USING (term), s GROUP BY ALL),
b AS (SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id NULLS LAST, row) AS place FROM r WHERE score > 0)
SELECT item_id, place::INTEGER AS rank, doc_id, score FROM b WHERE place <= 20"""
