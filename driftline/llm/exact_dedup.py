"""Exact deduplication by skew-safe combining."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftline.llm.common import lower_ascii

#: A digest's rows are spread over this many salts, both where groups merge and where rows meet their group.
SALTS = 32


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z; a null text is an empty one. The row
    with the largest id of a group is kept (a null id loses to any other; rows that repeat the
    kept id are kept as well, so an id never loses its last row). No rows give no rows; further
    columns of `df` are ignored, whatever their names.

    Three stages combine the groups, and each has the full text among its grouping keys, so that
    a digest alone never makes two texts equal: within a map task (the partial aggregate of the
    salted stage), within one salt of a digest, then over the salts. A group of any size thus
    sends at most one text per map task, and `salts` texts to the last stage. Rows then meet
    their group's outcome by digest, a second fingerprint and a salt; groups of one row need no
    such meeting. Different texts that share both hashes stop the query.
    """
    body = lower_ascii(F.col(text_col))
    hashed = df.select(F.col(id_col).alias("id"), body.alias("body")).select(
        "id", "body", F.unhex(F.sha2("body", 256)).alias("digest"), F.xxhash64("body").alias("print"), F.pmod(F.xxhash64("id"), F.lit(salts)).cast("int").alias("salt")
    )
    salted = hashed.groupBy("digest", "print", "body", "salt").agg(F.max("id").alias("keep_id"), F.count(F.lit(1)).alias("n"))
    whole = salted.repartition("digest").groupBy("digest", "print", "body").agg(F.max("keep_id").alias("keep_id"), F.sum("n").alias("n"))
    groups = whole.groupBy("digest", "print").agg(F.max("keep_id").alias("keep_id"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("bodies"))
    shared = groups.where("n > 1").select(
        "digest",
        "print",
        F.when(F.col("bodies") > 1, F.raise_error(F.lit("different texts share both fingerprints")).cast("long")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.col("n").alias("group_size"),
        F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"),
    )
    rows = hashed.select("id", "digest", "print", "salt").join(shared, ["digest", "print", "salt"], "left")
    keep = F.when(F.col("group_size").isNull(), F.col("id")).otherwise(F.col("keep_id"))
    return rows.select(
        F.col("id").alias(id_col),
        keep.alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.col("id").eqNullSafe(keep).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


ORACLE_SQL = """
WITH t AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
  FROM documents)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER g AS kept, text_sha256
FROM t WINDOW g AS (PARTITION BY text_sha256)
"""
