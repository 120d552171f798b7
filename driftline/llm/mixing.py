"""Mixing sources to target weights by capped water-filling."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftline.llm.common import WORD, checkpointed

#: Weights of the sources in code-point order, repeating.
WEIGHTS = (5, 2, 1)
#: The mix holds this share of all words, and no source more than this many times its own.
SHARE, MAX_EPOCHS = 1.5, 2
SEED = "mix-1"
#: A seeded place has 40 bits: two levels of 1024 bins, then 20 bits.
BIN_BITS, PLACE_BITS = 10, 40
#: A source's rows meet what is known of it in so many parts, as one source may hold a third of all rows.
SALTS = 32


def of_source(rows: DataFrame, known: DataFrame) -> DataFrame:
    """`rows` (key, salt, ...) with the columns of `known`, which has at most one row a key; rows of other keys go."""
    parts = known.select("*", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    return rows.join(parts, ["key", "salt"])


def mix_sources(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, max_epochs: int = MAX_EPOCHS, seed: str = SEED
) -> DataFrame:
    """One row per input row: id, size, source, source_size, target, repeats, taken.

    A size is a text's number of words (null or empty: 0). Water-filling: sources get words by
    weight, are clamped at `max_epochs` times their size, and the excess is shared by weight among
    the others until none is above; sorted by size over weight, the clamped ones come first, so
    prefix sums give that fixed point in one pass. A document is taken floor(target / source_size)
    times, and once more if the words of its source at seeded places before it, and half its own,
    are fewer than those still wanted. A source's words are thus within one document of the target.

    The place of that cut is found by narrowing: words per 1024 bins of a source, then per 1024
    bins of the bin that holds the cut, then the few rows of that one; no source's rows are ever
    sorted in one task. Null sources are one source, last in order. Places come from ids, so rows
    that repeat an id are taken or left together. A source without words has target 0. No rows
    give no rows; other columns are ignored. The table of sources meets the rows in a join on source and
    salt, which Spark turns into a broadcast only where the table measures under its threshold.
    """
    place = F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col(id_col).cast("string"), F.lit("null"))).cast("binary")), 1, PLACE_BITS // 4), 16, 10).cast("long")
    rows = checkpointed(
        df.select(
            F.col(id_col).alias("id"),
            F.col(source_col).cast("string").alias("source"),
            F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
            place.alias("place"),
        )
    )
    key = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("")).alias("key")
    rows = rows.select("*", key, F.pmod(F.xxhash64("id", "place"), F.lit(SALTS)).cast("int").alias("salt"))
    sources = rows.groupBy("key").agg(F.max("source").alias("source"), F.sum("size").alias("source_size"))

    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int")).cast("long")
    sources = sources.select("*", weight.alias("weight"))
    everything = Window.partitionBy()
    by_room = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_room.rowsBetween(Window.unboundedPreceding, -1)
    filled = sources.select(
        "*",
        F.sum("source_size").over(everything).alias("total"),
        F.sum("weight").over(everything).alias("weights"),
        F.coalesce(F.sum("source_size").over(before), F.lit(0)).alias("size_before"),
        F.coalesce(F.sum("weight").over(before), F.lit(0)).alias("weight_before"),
    )
    level = (F.lit(float(share)) * F.col("total") - F.lit(float(max_epochs)) * F.col("size_before")) / (F.col("weights") - F.col("weight_before"))
    cap = F.lit(float(max_epochs)) * F.col("source_size")
    # the first source whose cap is above its part at this level, and all after it, share that level
    filled = filled.select("*", F.when(F.col("weight") * level < cap, level).alias("open_level"))
    first_open = F.first("open_level", ignorenulls=True).over(by_room.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    target = F.when(first_open.isNull(), cap).otherwise(F.least(cap, F.col("weight") * first_open))
    filled = filled.select("key", "source", "source_size", target.alias("target"))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    filled = filled.select("*", whole.alias("whole")).select("*", (F.col("target") - F.col("whole") * F.col("source_size")).alias("wanted"))
    filled = checkpointed(filled)

    cuts = filled.select("key", "wanted", F.lit(0).cast("long").alias("prefix"), F.lit(0).cast("long").alias("words_before"))
    left = rows.select("key", "salt", "place", "id", "size")
    for shift in (PLACE_BITS - BIN_BITS, PLACE_BITS - 2 * BIN_BITS):
        bins = left.groupBy("key", F.shiftright("place", shift).alias("bin")).agg(F.sum("size").alias("words"))
        running = F.sum("words").over(Window.partitionBy("key").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1))
        bins = bins.select("*", F.coalesce(running, F.lit(0)).alias("run"))
        found = bins.join(cuts, "key").select("key", "wanted", "bin", "words", (F.col("words_before") + F.col("run")).alias("words_before"))
        cuts = checkpointed(found.where("words_before < wanted AND wanted <= words_before + words").select("key", "wanted", F.col("bin").alias("prefix"), "words_before"))
        left = of_source(left, cuts.select("key", "prefix")).where(F.shiftright("place", shift) == F.col("prefix")).drop("prefix")
    running = F.sum("size").over(Window.partitionBy("key").orderBy("place", "id").rowsBetween(Window.unboundedPreceding, -1))
    ends = left.select("*", F.coalesce(running, F.lit(0)).alias("run")).join(cuts, "key").where("words_before + run + size / 2.0D < wanted")
    ends = ends.groupBy("key").agg(F.max(F.struct("place", "id")).alias("end"))
    cuts = cuts.join(ends, "key", "left").select("key", F.shiftleft("prefix", PLACE_BITS - 2 * BIN_BITS).alias("start"), "end")

    plan = filled.join(cuts, "key", "left").select("key", "source_size", "target", "whole", "start", "end")
    extra = F.coalesce((F.col("place") < F.col("start")) | (F.struct("place", "id") <= F.col("end")), F.lit(False))
    mixed = of_source(rows, plan).select("*", (F.col("whole") + extra.cast("long")).alias("repeats"))
    return mixed.select(F.col("id").alias(id_col), "size", F.col("source").alias(source_col), "source_size", "target", "repeats", (F.col("size") * F.col("repeats")).alias("taken"))


ORACLE_SQL = r"""
WITH r AS (
  SELECT doc_id, source, ('0x' || md5('mix-1:' || coalesce(doc_id::VARCHAR, 'null'))[1:10])::BIGINT AS place,
         CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) END::BIGINT AS size
  FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size, [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS weight
  FROM r GROUP BY source),
b AS (
  SELECT *, sum(source_size) OVER ()::BIGINT AS total, sum(weight) OVER ()::BIGINT AS weights,
         coalesce(sum(source_size) OVER p, 0)::BIGINT AS size_before, coalesce(sum(weight) OVER p, 0)::BIGINT AS weight_before
  FROM s WINDOW p AS (ORDER BY source_size::DOUBLE / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT *, (1.5::DOUBLE * total - 2.0::DOUBLE * size_before) / (weights - weight_before) AS level FROM b),
o AS (
  SELECT *, first(CASE WHEN weight * level < 2.0::DOUBLE * source_size THEN level END IGNORE NULLS) OVER
    (ORDER BY source_size::DOUBLE / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS open_level
  FROM l),
t AS (
  SELECT source, source_size, CASE WHEN open_level IS NULL THEN 2.0::DOUBLE * source_size
         ELSE least(2.0::DOUBLE * source_size, weight * open_level) END AS target
  FROM o),
w AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS whole FROM t),
m AS (
  SELECT r.doc_id, r.size, w.source_size, w.target, w.whole, w.target - w.whole * w.source_size AS wanted,
         coalesce(sum(r.size) OVER (PARTITION BY r.source ORDER BY r.place, r.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS run
  FROM r JOIN w ON r.source IS NOT DISTINCT FROM w.source)
SELECT doc_id, size, source_size, target, (size * (whole + (run + size / 2.0::DOUBLE < wanted)::INT))::BIGINT AS taken FROM m
"""
