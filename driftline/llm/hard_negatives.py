"""Hard negatives by product quantisation with stored residual norms.

Every vector is stored as a codeword a subspace and the norm of what the codewords leave out. For an
anchor, a table of inner products with all codewords gives every row's score up to the residual's
share, which is at most the product of the two norms. Codewords, norms (rounded up) and scores are
integers, so the bounds hold without any rounding error; rows that they cannot rule out are scored
exactly.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from driftline.llm.common import checkpointed, shared_folder
from driftline.session import remove

#: Components of a subspace, codewords of it (a byte), rows that codewords are fitted to, rounds of that.
WIDTH, WORDS, SAMPLE, ROUNDS = 2, 256, 20_000, 8
#: Anchors of a block (one pass over all rows each), rows a worker takes at once, parts in which the best are cut first.
BLOCK, ROWS, PARTS = 1_024, 512, 64
#: Components of larger magnitude than this (after scaling) would leave 64-bit scores.
LARGEST = 2**26
NEVER = np.iinfo(np.int64).min


def scaled(df: DataFrame, id_col: str, vec_col: str, label_col: str, anchor: Column, scale: int) -> DataFrame:
    """row, id, label, anchor, vec (whole numbers) of rows that take part."""
    vec = F.transform(F.col(vec_col), lambda x: x.cast("double"))
    fine = F.col(label_col).isNotNull() & F.col(vec_col).isNotNull() & F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), F.coalesce(anchor, F.lit(False)).alias("anchor"), vec.alias("vec"), fine.alias("fine"))
    whole = F.transform("vec", lambda x: F.when(F.abs(x) * scale < LARGEST, F.floor(x * scale)).otherwise(F.raise_error(F.lit("a component is too large for exact scores")).cast("long")))
    return rows.where("fine").select(F.monotonically_increasing_id().alias("row"), "id", "label", "anchor", whole.alias("vec"))


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    """Vectors as rows of `dims` numbers; shorter ones are padded with zeros."""
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    if (sizes == dims).all():
        return values.reshape(-1, dims)
    out = np.zeros((len(sizes), dims), np.int64)
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[row, np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = values
    return out


def fit_codewords(sample: np.ndarray) -> np.ndarray:
    """(subspaces, WORDS, WIDTH) codewords of whole numbers, by k-means in each subspace, from a bounded sample."""
    rng = np.random.default_rng(7)
    books = []
    for s in range(0, sample.shape[1], WIDTH):
        x = sample[:, s : s + WIDTH].astype(np.float64)
        distinct = np.unique(x, axis=0)
        book = distinct[np.sort(rng.choice(len(distinct), min(WORDS, len(distinct)), replace=False))]
        for _ in range(ROUNDS):
            near = nearest(x, book)
            held = np.bincount(near, minlength=len(book))
            sums = np.stack([np.bincount(near, weights=x[:, j], minlength=len(book)) for j in range(x.shape[1])], 1)
            book = np.where(held[:, None] > 0, sums / np.maximum(held, 1)[:, None], book)
        books.append(np.pad(np.rint(book), ((0, WORDS - len(book)), (0, 0)), mode="edge"))
    return np.stack(books).astype(np.int64)


def nearest(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    return ((book.astype(np.float64) ** 2).sum(1) - 2 * x @ book.T.astype(np.float64)).argmin(1)


def up_root(x: np.ndarray) -> np.ndarray:
    """The least whole number whose square is at least x."""
    root = np.sqrt(x.astype(np.float64)).astype(np.int64)
    root = np.where(root * root > x, root - 1, root)
    return np.where(root * root < x, root + 1, root)


def encoded(books: np.ndarray, dims: int):
    """A function from batches of rows to the same with a byte a subspace and the residual's norm, rounded up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column("vec"), dims)
            codes = np.stack([nearest(x[:, s * WIDTH : (s + 1) * WIDTH], b) for s, b in enumerate(books)], 1).astype(np.uint8) if len(x) else np.zeros((0, len(books)), np.uint8)
            near = np.concatenate([b[codes[:, s]] for s, b in enumerate(books)], 1)
            norm = up_root(((x - near) ** 2).sum(1))
            packed = codes.tobytes()
            width = len(books)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([packed[i * width : (i + 1) * width] for i in range(len(x))], pa.binary()), pa.array(norm, pa.int64())], names=[*batch.schema.names, "codes", "norm"])

    return run


class Anchors:
    """A block of anchors with their tables of inner products."""

    def __init__(self, rows: list, books: np.ndarray, dims: int):
        self.row = np.array([r["row"] for r in rows], np.int64)
        self.label = np.array([r["label"] for r in rows], np.int64)
        self.vec = np.zeros((len(rows), dims), np.int64)
        for i, r in enumerate(rows):
            self.vec[i, : len(r["vec"])] = r["vec"]
        self.norm = up_root((self.vec**2).sum(1))
        self.books, self.dims = books, dims

    def tables(self) -> np.ndarray:
        return np.einsum("asw,skw->ask", self.vec.reshape(len(self.row), -1, WIDTH), self.books)

    def bounds(self, tables: np.ndarray, codes: np.ndarray, norm: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bounds of every anchor's score with every row."""
        about = np.zeros((len(self.row), len(codes)), np.int64)
        for s in range(codes.shape[1]):
            about += tables[:, s][:, codes[:, s]]
        off = self.norm[:, None] * norm[None, :]
        return about - off, about + off

    def scores(self, a: np.ndarray, x: np.ndarray) -> np.ndarray:
        return np.einsum("ij,ij->i", self.vec[a], x)


def pieces(batches: Iterator[pa.RecordBatch], books: np.ndarray) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
    """Batches in bounded pieces, with codes, norms and labels."""
    for whole in batches:
        for a in range(0, whole.num_rows, ROWS):
            batch = whole.slice(a, ROWS)
            codes = np.frombuffer(b"".join(batch.column("codes").to_pylist()), np.uint8).reshape(-1, len(books))
            yield batch, codes, batch.column("norm").to_numpy(), batch.column("label").to_numpy()


def largest(best: np.ndarray, more: np.ndarray) -> np.ndarray:
    """Row by row the largest values of both, as many as `best` has."""
    return np.partition(np.concatenate([best, more], 1), -best.shape[1], axis=1)[:, -best.shape[1] :]


def found_bounds(best: np.ndarray) -> pa.RecordBatch:
    key = np.repeat(np.arange(len(best)), best.shape[1])
    held = best.ravel() > NEVER
    return pa.RecordBatch.from_arrays([pa.array(key[held], pa.int32()), pa.array(best.ravel()[held], pa.int64())], names=["key", "value"])


def kept_rows(kept: dict[int, list[tuple]]) -> pa.RecordBatch:
    flat = [(key, row, None if null else ident, -score) for key, rows in kept.items() for score, null, ident, row in rows]
    return pa.RecordBatch.from_arrays([pa.array([x[j] for x in flat], t) for j, t in enumerate((pa.int32(), pa.int64(), pa.int64(), pa.int64()))], names=["key", "row", "id", "value"])


def keep_best(kept: dict[int, list[tuple]], keys: np.ndarray, at: np.ndarray, score: np.ndarray, batch: pa.RecordBatch, k: int) -> None:
    """Adds rows to the best `k` of their keys, which come in ascending order: by score, then id, nulls last."""
    row, ident = batch.column("row").to_numpy(), batch.column("id").to_pylist()
    distinct, first = np.unique(keys, return_index=True)
    for key, a, b in zip(distinct, first, [*first[1:], len(keys)], strict=True):
        mine = np.arange(a, b)
        if len(mine) > 4 * k:
            mine = mine[score[mine] >= np.partition(score[mine], -k)[-k]]
        more = [(-int(score[j]), ident[at[j]] is None, ident[at[j]] if ident[at[j]] is not None else 0, int(row[at[j]])) for j in mine]
        kept[int(key)] = sorted(kept.get(int(key), []) + more)[:k]


def positive_bounds(anchors: Anchors, k: int):
    """(key, value): of each anchor a task's k largest lower bounds among other rows of its label."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables, best = anchors.tables(), np.full((len(anchors.row), k), NEVER)
        for batch, codes, norm, label in pieces(batches, anchors.books):
            low, _ = anchors.bounds(tables, codes, norm)
            other = (label[None, :] == anchors.label[:, None]) & (batch.column("row").to_numpy()[None, :] != anchors.row[:, None])
            best = largest(best, np.where(other, low, NEVER))
        yield found_bounds(best)

    return run


def exact_positives(anchors: Anchors, least: np.ndarray, k: int):
    """(key, row, id, value): of each anchor a task's k best positives by exact score, of those whose upper bound reaches `least`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables, kept = anchors.tables(), {}
        for batch, codes, norm, label in pieces(batches, anchors.books):
            _, up = anchors.bounds(tables, codes, norm)
            a, at = np.nonzero((up >= least[:, None]) & (label[None, :] == anchors.label[:, None]) & (batch.column("row").to_numpy()[None, :] != anchors.row[:, None]))
            if len(a):
                keep_best(kept, a, at, anchors.scores(a, matrix(batch.column("vec"), anchors.dims)[at]), batch, k)
        yield kept_rows(kept)

    return run


class Windows:
    """Score windows of negatives, each of one anchor's one positive; a key is a window's number."""

    def __init__(self, of: np.ndarray, low: np.ndarray, high: np.ndarray):
        self.of, self.low, self.high = of, low, high


def window_bounds(anchors: Anchors, windows: Windows, k: int):
    """(key, value): of each window a task's k largest lower bounds among rows of other labels that lie in it for certain."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables, best = anchors.tables(), np.full((len(windows.of), k), NEVER)
        for _, codes, norm, label in pieces(batches, anchors.books):
            low, up = anchors.bounds(tables, codes, norm)
            low = np.where(label[None, :] != anchors.label[:, None], low, NEVER)
            mine = low[windows.of]
            best = largest(best, np.where((mine >= windows.low[:, None]) & (up[windows.of] <= windows.high[:, None]), mine, NEVER))
        yield found_bounds(best)

    return run


def exact_negatives(anchors: Anchors, windows: Windows, least: np.ndarray, k: int):
    """(key, row, id, value): of each window a task's k best rows of other labels by exact score, of those whose bounds let them in."""
    floor = np.maximum(windows.low, least)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables, kept = anchors.tables(), {}
        for batch, codes, norm, label in pieces(batches, anchors.books):
            low, up = anchors.bounds(tables, codes, norm)
            other = label[None, :] != anchors.label[:, None]
            key, at = np.nonzero(other[windows.of] & (up[windows.of] >= floor[:, None]) & (low[windows.of] <= windows.high[:, None]))
            if len(key):
                score = anchors.scores(windows.of[key], matrix(batch.column("vec"), anchors.dims)[at])
                inside = (score >= windows.low[key]) & (score <= windows.high[key])
                keep_best(kept, key[inside], at[inside], score[inside], batch, k)
        yield kept_rows(kept)

    return run


def first_of(rows: DataFrame, k: int, *order) -> DataFrame:
    """Of each key the first `k` rows and their place; cut in parts first, so that what many tasks found never meets whole."""
    parts = rows.withColumn("part", F.spark_partition_id() % PARTS)
    for keys in (["key", "part"], ["key"]):
        parts = parts.drop("place").withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("place") <= k)
    return parts.drop("part")


def thresholds(bounds: DataFrame, keys: int, k: int) -> np.ndarray:
    """The k-th largest lower bound of each key; a number a key of a block reaches the driver."""
    out = np.full(keys, NEVER)
    for key, value in first_of(bounds, k, F.desc("value")).where(F.col("place") == k).select("key", "value").collect():
        out[key] = value
    return out


def mine_block(index: DataFrame, anchors: Anchors, n_positives: int, n_negatives: int, low_percent: int, high_percent: int) -> DataFrame:
    """key, id, value, place of one block's negatives, with its positives' columns."""
    spark = index.sparkSession
    coded, exact = index.select("row", "label", "codes", "norm"), "key int, row long, id long, value long"
    order = (F.desc("value"), F.asc_nulls_last("id"), "row")
    least = thresholds(coded.mapInArrow(positive_bounds(anchors, n_positives), "key int, value long"), len(anchors.row), n_positives)
    positives = first_of(index.mapInArrow(exact_positives(anchors, least, n_positives), exact), n_positives, *order).collect()  # n_positives an anchor of the block
    of = np.array([p["key"] for p in positives], np.int64)
    score = np.array([p["value"] for p in positives], np.int64)
    windows = Windows(of, -(-low_percent * score // 100), high_percent * score // 100)
    least = thresholds(coded.mapInArrow(window_bounds(anchors, windows, n_negatives), "key int, value long"), len(of), n_negatives)
    found = first_of(index.mapInArrow(exact_negatives(anchors, windows, least, n_negatives), exact), n_negatives, *order)
    told = spark.createDataFrame([(i, int(anchors.row[p["key"]]), p["id"], p["value"]) for i, p in enumerate(positives)], "key int, anchor_row long, positive_id long, positive_score long")
    return found.join(F.broadcast(told), "key").select("anchor_row", "positive_id", F.col("place").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("value").alias("negative_score"))


def blocks_of(rows: DataFrame) -> Iterator[list]:
    block = []
    for r in rows.toLocalIterator():
        block.append(r)
        if len(block) == BLOCK:
            yield block
            block = []
    if block:
        yield block


def hard_negatives(
    df: DataFrame, anchor: Column, n_positives: int = 5, n_negatives: int = 10, low_percent: int = 30, high_percent: int = 90, scale: int = 256, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label"
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Anchors are the rows for which `anchor` is true: the stated queries, taken in blocks of BLOCK,
    each four passes over all rows' codes. Positives are an anchor's `n_positives` best other rows of
    its label; negatives of a positive are the `n_negatives` best rows of other labels whose score is
    between `low_percent` and `high_percent` of the positive's. Scores are inner products of
    floor(scale * x); equal ones come by ascending id, null ids last. Codewords are fitted to at most
    SAMPLE rows; every row is indexed. Rows with a null label or vector, or a null or non-finite
    component take no part; rows are told apart by place, not by id, so repeated rows are positives
    of each other and rows with a null id may be positives or negatives, and are anchors if `anchor`
    says so; vectors of unlike length count as padded with zeros. Components are below 2^26 after
    scaling, or the query ends with an error. Empty tables give no rows; other columns play no part.
    """
    spark: SparkSession = df.sparkSession
    folder = f"{shared_folder(spark)}/negatives-{uuid.uuid4().hex}"
    scaled(df, id_col, vec_col, label_col, anchor, scale).write.parquet(f"{folder}/rows")
    rows = spark.read.parquet(f"{folder}/rows")
    dims, n = rows.agg(F.coalesce(F.max(F.size("vec")), F.lit(0)), F.count(F.lit(1))).first()
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if not dims:
        return spark.createDataFrame([], schema)
    dims += -dims % WIDTH
    share = F.lit(min(1.0, SAMPLE / n))
    sample = rows.where(F.pmod(F.xxhash64("row"), F.lit(1_000_003)) < share * 1_000_003).select("vec").limit(SAMPLE).toArrow().combine_chunks()
    vecs = sample.column("vec").combine_chunks() if sample.num_rows else rows.select("vec").limit(SAMPLE).toArrow().column("vec").combine_chunks()
    books = fit_codewords(matrix(vecs, dims))
    rows.mapInArrow(encoded(books, dims), "row long, id long, label long, anchor boolean, vec array<long>, codes binary, norm long").write.parquet(f"{folder}/index")
    remove(spark, f"{folder}/rows")
    index = spark.read.parquet(f"{folder}/index")
    found = []
    for block in blocks_of(index.where("anchor").select("row", "id", "label", "vec")):
        mined = mine_block(index, Anchors(block, books, dims), n_positives, n_negatives, low_percent, high_percent)
        ids = spark.createDataFrame([(r["row"], r["id"]) for r in block], "anchor_row long, anchor_id long")
        found.append(checkpointed(mined.join(F.broadcast(ids), "anchor_row").select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")))
    remove(spark, folder)
    return reduce(DataFrame.unionByName, found) if found else spark.createDataFrame([], schema)


ORACLE_SQL = """
WITH e AS (SELECT row_number() OVER () AS row, vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS vec
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.row AS anchor_row, a.id AS anchor_id, b.row, b.id, a.label = b.label AS same, list_inner_product(a.vec, b.vec)::BIGINT AS score FROM e a JOIN e b ON a.row <> b.row WHERE a.id % 100 = 0),
p AS (SELECT *, row_number() OVER (PARTITION BY anchor_row ORDER BY score DESC, id, row) AS place FROM s WHERE same),
n AS (SELECT p.anchor_id, p.id AS positive_id, p.score AS positive_score, s.id AS negative_id, s.score AS negative_score,
        row_number() OVER (PARTITION BY p.anchor_row, p.place ORDER BY s.score DESC, s.id, s.row) AS place
      FROM p JOIN s ON p.anchor_row = s.anchor_row AND NOT s.same AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score WHERE p.place <= 5)
SELECT anchor_id, positive_id, place::INTEGER AS rank, negative_id, positive_score, negative_score FROM n WHERE place <= 10"""
