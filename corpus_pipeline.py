"""From documents to packed training sequences: five stages, each an operator of driftline.llm."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.llm import exact_dedup, language_id, mixing, ngram_join, packing
from driftline.llm.common import checkpointed, lower_ascii, shared_folder
from driftline.session import release, remove


#: Parts of lines that a packing worker keeps, which other stages' tasks in the same worker find in its memory.
REMEMBERED = 150_000


def numbered(docs: DataFrame) -> DataFrame:
    """`docs` with columns named by their place, so that no name of theirs can clash with a stage's own."""
    return docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])


def rows_of(docs: DataFrame, text: Column) -> DataFrame:
    """row (all columns), id, digest (of `text`): what tells rows apart where ids are null or repeat."""
    return docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("id"), F.unhex(F.sha2(text, 256)).alias("digest"))


def same_row(a: str, b: str) -> Column:
    return F.col(f"{a}.id").eqNullSafe(F.col(f"{b}.id")) & (F.col(f"{a}.digest") == F.col(f"{b}.digest"))


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text tells a language; nothing but texts without a letter (null, empty) is rejected.

    Rows are judged one by one, whatever their ids, so repeated ones stay or go together; without
    any labelled row all texts with a letter stay; all columns are kept as they are; no rows give none.
    """
    model = language_id.fit(docs)
    if model is None:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    rows = numbered(docs)
    judged = language_id.identify(rows, model, f"c{docs.columns.index('text')}")
    return judged.where(F.col("lang_pred") != language_id.UNKNOWN).select(*rows.columns).toDF(*docs.columns)


def keep_one_of_equals(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal texts one, with the largest id; a null id is less than any other, a null text an empty one.

    Of rows that repeat both that id and the text the least by all columns stays; other columns have no say; no rows give none.
    """
    release(spark)  # what finished stages left on the driver, which weighs where they had many tasks
    found = exact_dedup.exact_dedup(docs).where("kept").groupBy(F.col("doc_id").alias("id"), F.unhex("text_sha256").alias("digest")).agg(F.count(F.lit(1)).alias("n"))
    found = checkpointed(found)
    rows = rows_of(docs, lower_ascii(F.col("text"))).alias("a")
    out = rows.join(found.where("n = 1").alias("b"), same_row("a", "b"), "left_semi").select("row.*")
    repeated = found.where("n > 1")
    if repeated.isEmpty():
        return out
    many = rows.join(repeated.alias("b"), same_row("a", "b"), "left_semi")
    one = many.groupBy("id", "digest").agg(F.min("row").alias("row"))  # combined map-side: however often a row repeats
    return out.unionByName(one.select("row.*"))


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that links of 5-word Jaccard similarity 0.8 connect the one with the smallest id (null first; of those with that id the smallest digest of the text).

    Texts without words (null, empty) have no links and stay; rows that repeat an id and a text stay or
    go together; other columns have no say; no rows give none.
    """
    release(spark)  # what finished stages left on the driver, which weighs where they had many tasks
    key = F.coalesce("doc_id", F.lit(ngram_join.NO_ID))
    linked = checkpointed(ngram_join.ngram_join(docs, digests=True).where("root IS NOT NULL").select(key.alias("id"), "digest", "root"))
    release(spark)
    first = linked.groupBy("root").agg(F.min(F.struct("id", "digest")).alias("first")).select("first.*")
    dropped = linked.select("id", "digest").distinct().join(first, ["id", "digest"], "left_anti")
    rows = rows_of(docs, F.coalesce("text", F.lit(""))).withColumn("id", F.coalesce("id", F.lit(ngram_join.NO_ID)))
    return rows.join(dropped, ["id", "digest"], "left_anti").select("row.*")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, repeats as rows of their own.

    Rows that repeat an id and a source are taken alike, null ids and sources among them; a null text
    has no words and comes as often as others at its place; all columns are kept; no rows give none.
    """
    release(spark)  # what finished stages left on the driver, which weighs where they had many tasks
    times = mixing.mix_sources(docs).where("repeats > 0").select(F.col("doc_id").alias("id"), F.col("source").alias("source"), F.col("repeats").cast("int").alias("repeats")).distinct()
    release(spark)
    rows = docs.select(F.struct("*").alias("row"))
    same = F.col("row.doc_id").eqNullSafe(F.col("id")) & F.col("row.source").cast("string").eqNullSafe(F.col("source"))
    return rows.join(times, same).select("row", F.explode(F.sequence(F.lit(1), F.col("repeats"))).alias("copy")).select("row.*")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents, packed into sequences; every row is packed, null texts as empty ones, repeated rows as often as they come."""
    release(spark)  # what finished stages left on the driver, which weighs where they had many tasks
    return packing.pack(docs, remembered=REMEMBERED)


STAGES = [
    ("language id", keep_known_languages),
    ("exact dedup", keep_one_of_equals),
    ("n-gram jaccard join", keep_one_of_near_copies),
    ("mixing to target weights", mix),
    ("packing", pack),
]

#: Language identification is learned, so SQL cannot give the pipeline's rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table of documents; each result is written to the shared folder and read again, and goes when the next is written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_folder(spark)}/corpus-pipeline-{uuid.uuid4().hex}"
    for number, (_, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{number}")
        docs = spark.read.parquet(f"{folder}/{number}")
        if number:
            remove(spark, f"{folder}/{number - 1}")
    return STAGES[-1][1](spark, docs, sf_dir)
