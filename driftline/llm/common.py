"""Pieces shared by the corpus operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.session import checkpointed, release, shared_folder

__all__ = ["checkpointed", "crc32_fold", "documents", "let", "lower_ascii", "release", "shared_folder", "words"]

#: Words are maximal runs of characters other than these six (space, tab, LF, VT, FF, CR).
SPACES = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole table of documents."""
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def let(value: Column, body) -> Column:
    """`body(value)` with `value` computed once a row, however often `body` mentions it.

    A column captured by a higher-order function's lambda is otherwise computed for every element.
    """
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    """The words of a text, in order; null gives an empty array."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACES + "+"), "")


def lower_ascii(text: Column) -> Column:
    """Null as empty; only A-Z become lower case."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def crc32_fold(doc_id: Column, folds: int = 5) -> Column:
    """crc32 of the id as text, modulo `folds`; null ids count as the empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(folds)).cast("int")
