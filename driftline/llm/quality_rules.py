"""Document quality rules with host verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftline.llm.common import SPACES, checkpointed, let, words

WINDOW = 8
SYMBOLS = "#*$%&|<>"
MIN_WORDS, MAX_REPEAT_PERCENT = 20, 30
#: A host whose shrunken failure rate is above this loses all its documents.
MAX_HOST_RATE = 0.5
#: Bounds on the prior's weight in documents, for hosts that all fail alike or hardly alike.
PRIOR_WEIGHT = (2.0, 1000.0)


def repeat_words(tokens: Column, width: int = WINDOW) -> Column:
    """Words of `tokens` that lie in `width`-word windows found twice or more, the first included.

    Window hashes tell texts without any repeat (two equal windows have equal hashes); others
    are settled on the windows themselves, sorted so that equal ones are neighbours.
    """

    def of_words(w: Column) -> Column:
        starts = F.sequence(F.lit(0), F.size(w) - width)
        hashes = let(F.transform(w, lambda x: F.xxhash64(x)), lambda h: F.transform(starts, lambda i: F.xxhash64(F.slice(h, i + 1, width))))
        differ = let(hashes, lambda h: F.size(F.array_distinct(h)) == F.size(h))
        keyed = F.sort_array(F.transform(starts, lambda i: F.struct(F.array_join(F.slice(w, i + 1, width), " ").alias("k"), i.alias("p"))))

        def twice(s: Column) -> Column:
            last = F.size(s) - 1
            same = lambda a, b: s[a]["k"] == s[b]["k"]
            at = F.filter(F.sequence(F.lit(0), last), lambda j: F.when(j > 0, same(j, F.greatest(j - 1, F.lit(0)))).otherwise(F.lit(False)) | F.when(j < last, same(j, F.least(j + 1, last))).otherwise(F.lit(False)))
            return F.sort_array(F.transform(at, lambda j: s[j]["p"]))

        covered = F.aggregate(
            let(keyed, twice),
            F.struct(F.lit(-width).alias("prev"), F.lit(0).cast("long").alias("n")),
            lambda a, p: F.struct(p.alias("prev"), (a["n"] + F.least(F.lit(width), p - a["prev"])).alias("n")),
            lambda a: a["n"],
        )
        return F.when(differ, F.lit(0).cast("long")).otherwise(covered)

    return F.when(F.size(tokens) <= width, F.lit(0).cast("long")).otherwise(let(tokens, of_words))


def document_rules(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """Rule measures of each document, with id and host; a null text counts as an empty one."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = df.select(F.col(id_col).alias("id"), F.col(host_col).cast("string").alias("host"), text.alias("body"), words(F.col(text_col)).alias("tokens"))
    measured = rows.select(
        "id",
        "host",
        F.size("tokens").cast("long").alias("n_words"),
        F.length(F.regexp_replace("body", SPACES + "+", "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("body", f"[^{SYMBOLS}]+", "")).cast("long").alias("n_symbols"),
        let(F.filter(F.split("body", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")), lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        repeat_words(F.col("tokens")).alias("n_repeat_words"),
    )
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return measured.select("*", failed.alias("base_failed"))


def host_rates(measured: DataFrame) -> DataFrame:
    """host, docs, failures, host_rate: failure rates shrunk with a beta prior fitted to all hosts.

    The prior has the mean of all documents and, by the method of moments, the weight that the
    spread of the hosts' rates beyond binomial noise leaves; without any such spread it is at its
    upper bound. Only four sums over the hosts reach the driver.
    """
    hosts = measured.groupBy("host").agg(F.count(F.lit(1)).alias("docs"), F.count_if("base_failed").alias("failures"))
    n, k, n2, k2n = hosts.agg(F.sum("docs"), F.sum("failures"), F.sum(F.col("docs") * F.col("docs") * 1.0), F.sum(F.col("failures") * F.col("failures") / F.col("docs"))).first()
    count = hosts.count() if n else 0
    mean = (k + 0.5) / (n + 1) if n else 0.5
    weight = PRIOR_WEIGHT[1]
    if n and count > 1:
        # sum of docs * (rate - mean)^2 expects noise * (count - 1) + between * (n - n2 / n)
        spread = k2n - 2 * mean * k + mean * mean * n
        between = (spread - mean * (1 - mean) * (count - 1)) / max(n - n2 / n, 1e-9)
        if between > 0:
            weight = min(max(mean * (1 - mean) / between - 1, PRIOR_WEIGHT[0]), PRIOR_WEIGHT[1])
    return hosts.select("*", ((F.col("failures") + mean * weight) / (F.col("docs") + weight)).alias("host_rate"))


def quality_rules(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", max_host_rate: float = MAX_HOST_RATE) -> DataFrame:
    """One row per input row: id, host, rule measures, base_failed, host_rate, host_ok, kept.

    A document is kept if it passes its own rules and its host's shrunken failure rate is at most
    `max_host_rate`. Null and empty texts have no words and fail; null hosts form one host; rows
    that repeat are judged alike. No rows give no rows; other columns are ignored. Measures are
    computed once into the shared checkpoint folder; hosts meet their documents in a join that
    Spark broadcasts only if the hosts' table measures under its threshold, and otherwise splits
    where one host is hot.
    """
    measured = checkpointed(document_rules(df, id_col, text_col, host_col))
    key = F.coalesce(F.concat(F.lit("="), F.col("host")), F.lit("")).alias("key")
    rates = host_rates(measured).select(key, "host_rate")
    joined = measured.select("*", key).join(rates, "key").drop("key")
    ok = F.col("host_rate") <= max_host_rate
    return joined.withColumnRenamed("id", id_col).select("*", ok.alias("host_ok"), (~F.col("base_failed") & ok).alias("kept"))


ORACLE_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS body FROM documents),
t AS (SELECT rid, regexp_extract_all(body, '[^\x20\x09-\x0D]+') AS w FROM d),
u AS (SELECT rid, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM t),
v AS (
  SELECT rid, i, CASE WHEN lead(i, 7) OVER o IS NOT NULL THEN concat_ws(' ', x, lead(x, 1) OVER o, lead(x, 2) OVER o, lead(x, 3) OVER o,
         lead(x, 4) OVER o, lead(x, 5) OVER o, lead(x, 6) OVER o, lead(x, 7) OVER o) END AS win
  FROM u WINDOW o AS (PARTITION BY rid ORDER BY i)),
c AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, win) AS n FROM v WHERE win IS NOT NULL),
p AS (SELECT rid, i, lag(i) OVER (PARTITION BY rid ORDER BY i) AS prev FROM c WHERE n > 1),
q AS (SELECT rid, sum(least(8, i - coalesce(prev, i - 8)))::BIGINT AS n_repeat_words FROM p GROUP BY rid),
m AS (
  SELECT d.doc_id, d.source, len(t.w)::BIGINT AS n_words, length(regexp_replace(body, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
         length(regexp_replace(body, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
         (len(list_filter(string_split(body, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))
          - len(list_distinct(list_filter(string_split(body, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))))::BIGINT AS n_dup_lines,
         coalesce(q.n_repeat_words, 0)::BIGINT AS n_repeat_words
  FROM d JOIN t USING (rid) LEFT JOIN q USING (rid)),
f AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m),
h AS (SELECT source, count(*) AS docs, count(*) FILTER (WHERE base_failed) AS failures FROM f GROUP BY source),
g AS (
  SELECT sum(docs)::DOUBLE AS n, sum(failures)::DOUBLE AS k, sum(docs * docs)::DOUBLE AS n2, sum(failures * failures / docs::DOUBLE) AS k2n, count(*) AS hosts,
         (sum(failures) + 0.5) / (sum(docs) + 1)::DOUBLE AS mean FROM h),
b AS (SELECT *, (k2n - 2 * mean * k + mean * mean * n - mean * (1 - mean) * (hosts - 1)) / greatest(n - n2 / n, 1e-9) AS between_hosts FROM g),
a AS (SELECT mean, CASE WHEN hosts > 1 AND between_hosts > 0 THEN least(greatest(mean * (1 - mean) / between_hosts - 1, 2), 1000) ELSE 1000 END AS weight FROM b),
r AS (SELECT source, (failures + mean * weight) / (docs + weight) AS host_rate FROM h, a)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND host_rate <= 0.5 AS kept
FROM f JOIN r ON f.source IS NOT DISTINCT FROM r.source
"""
