"""Statistics of outcomes: tails, equity, strategy and classification metrics, calibration.

Percentiles are exact with linear interpolation; equity curves are the only ones that need an
order, everything else is a plain aggregate with partial sums.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftline.session import checkpointed

#: Rows of a side that is sent to all tasks.
MOST_BROADCAST = 100_000


def tail(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """n, mean, median, p5, p95, p99, shares at 100 and above, and the mean strictly below p99."""
    v = F.col(value)
    base = rows.groupBy(*keys).agg(
        F.count(v).alias("n"), F.avg(v).alias("mean"), F.percentile(v, F.lit(0.5)).alias("median"), F.percentile(v, F.lit(0.05)).alias("p5"),
        F.percentile(v, F.lit(0.95)).alias("p95"), F.percentile(v, F.lit(0.99)).alias("p99"), F.avg((v >= 100).cast("double")).alias("share_double"),
    )
    trimmed = rows.join(base.select(*keys, "p99"), keys).where(v < F.col("p99")).groupBy(*keys).agg(F.avg(v).alias("mean_below_p99"))
    return base.join(trimmed, keys, "left")


def equity(rows: DataFrame, keys: list[str], pnl: str, order: list[str]) -> DataFrame:
    """Adds balance, its running peak and drawdown, in the given order, which must settle all ties that matter.

    Ranges of keys and order are summed alone, then each gets the balance and the peak before it, so
    a task holds a range, not a key; the window over a key has one row a range.
    """
    dealt = checkpointed(rows.repartitionByRange(*keys, *order).withColumn("__part", F.spark_partition_id()))  # ranges are sampled, so both uses must see the same ones
    w = Window.partitionBy(*keys, "__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = dealt.select("*", F.sum(pnl).over(w).alias("__in"))
    parts = run.groupBy(*keys, "__part").agg(F.sum(pnl).alias("__all"), F.max("__in").alias("__most"))
    before = Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("*", F.sum("__all").over(before).alias("__base"))
    parts = parts.select("*", F.max(F.coalesce("__base", F.lit(0)) + F.col("__most")).over(before).alias("__high"))
    parts = parts.select(*[F.col(k).alias(f"__of_{i}") for i, k in enumerate(keys)], F.col("__part").alias("__of"), "__base", "__high")
    same = F.col("__part") == F.col("__of")
    for i, k in enumerate(keys):
        same &= F.col(k).eqNullSafe(F.col(f"__of_{i}"))
    run = run.select("*", F.max("__in").over(w).alias("__top")).join(parts, same)
    run = run.select(*rows.columns, F.coalesce(F.col("__base") + F.col("__in"), "__in", "__base").alias("balance"), F.greatest(F.coalesce("__base", F.lit(0)) + F.col("__top"), "__high", F.lit(0)).alias("peak"))
    return run.select("*", (F.col("peak") - F.col("balance")).alias("drawdown"))


def strategy(rows: DataFrame, keys: list[str], pnl: str, order: list[str]) -> DataFrame:
    """n, win_rate, expectancy, profit_factor (null without a loss), max_drawdown, end_balance."""
    p = F.col(pnl)
    gain, loss = F.sum(F.when(p > 0, p).otherwise(0)), F.sum(F.when(p < 0, -p).otherwise(0))
    return equity(rows, keys, pnl, order).groupBy(*keys).agg(
        F.count(p).alias("n"), F.avg((p > 0).cast("double")).alias("win_rate"), F.avg(p).alias("expectancy"),
        F.when(loss > 0, gain.cast("double") / loss.cast("double")).alias("profit_factor"), F.max("drawdown").alias("max_drawdown"), F.sum(p).alias("end_balance"),
    )


def brier_logloss(rows: DataFrame, y: str, p: str) -> DataFrame:
    q = F.least(F.greatest(F.col(p), F.lit(1e-8)), F.lit(1 - 1e-8))
    return rows.agg(
        F.count(F.lit(1)).alias("n"),
        F.avg((F.col(p) - F.col(y)) * (F.col(p) - F.col(y))).alias("brier"),
        F.avg(-F.when(F.col(y) == 1, F.log(q)).otherwise(F.log(1 - q))).alias("log_loss"),
    )


def by_score(rows: DataFrame, y: str, p: str) -> DataFrame:
    """Positives and negatives of each distinct score: what rank statistics need, usually far fewer rows than the input."""
    return rows.groupBy(F.col(p).alias("p")).agg(F.sum(y).cast("long").alias("pos"), F.sum(1 - F.col(y)).cast("long").alias("neg"))


def running(rows: DataFrame, order: Column, **sums: Column) -> DataFrame:
    """Adds each sum over all rows before a row in `order`: ranges of it are summed alone, then each range gets what is before it.

    The only window without a key is over one row a range, as many as there are shuffle partitions.
    """
    dealt = rows.select("*", *[v.alias(f"__{k}") for k, v in sums.items()]).repartitionByRange(order).withColumn("__part", F.spark_partition_id())
    dealt = checkpointed(dealt)  # ranges are sampled, so both uses must see the same ones
    inside = Window.partitionBy("__part").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    parts = dealt.groupBy("__part").agg(*[F.sum(f"__{k}").alias(f"{k}__all") for k in sums])
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("__part", *[F.coalesce(F.sum(f"{k}__all").over(before), F.lit(0)).alias(f"{k}__all") for k in sums])
    out = dealt.select("*", *[F.coalesce(F.sum(f"__{k}").over(inside), F.lit(0)).alias(f"{k}__in") for k in sums]).join(parts, "__part")
    return out.select(*rows.columns, *[(F.col(f"{k}__in") + F.col(f"{k}__all")).alias(k) for k in sums])


def roc_auc(rows: DataFrame, y: str, p: str) -> DataFrame:
    """Area under the ROC curve; equal scores count half."""
    s = running(by_score(rows, y, p), F.col("p"), below=F.col("neg"))
    return s.agg((F.sum(F.col("pos") * (F.col("below") + F.col("neg") / 2.0)) / (F.sum("pos") * F.sum("neg"))).alias("auc"))


def pr_auc(rows: DataFrame, y: str, p: str) -> DataFrame:
    """Average precision over distinct scores, from the highest."""
    s = running(by_score(rows, y, p), F.col("p").desc(), above=F.col("pos"), seen=F.col("pos") + F.col("neg"))
    tp, every = F.col("above") + F.col("pos"), F.col("seen") + F.col("pos") + F.col("neg")
    return s.agg((F.sum(F.col("pos") * tp / every) / F.sum("pos")).alias("pr_auc"))


def reliability(rows: DataFrame, y: str, p: str, edges: list[float]) -> DataFrame:
    """bin, n, mean score, mean outcome of score bins [edge, next edge), the last one closed."""
    at = sum([(F.col(p) >= e).cast("int") for e in edges[1:-1]], F.lit(0))
    return rows.groupBy(at.cast("long").alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg(p).alias("mean_score"), F.avg(y).alias("mean_outcome"))


def quantile_reliability(rows: DataFrame, y: str, p: str, most: int = 10) -> DataFrame:
    """bin, n, mean score, mean outcome between equal quantiles of the score, each bin with its upper edge, the first with both.

    As many bins as there are scores, 25 rows a bin, and `most` allow, but two at least; equal edges become one. Quantiles
    lie between the two nearest rows; rows without a score or outcome take no part; one score is one bin.
    """
    known = rows.where(F.col(y).isNotNull() & F.col(p).isNotNull() & ~F.isnan(F.col(p).cast("double")))
    s = running(by_score(known, y, p).withColumn("n", F.col("pos") + F.col("neg")), F.col("p"), before=F.col("n"))
    total = s.agg(F.sum("n").alias("all"), F.count(F.lit(1)).alias("scores")).select("all", F.least(F.lit(most), F.greatest(F.lit(2), F.expr("all div 25")), "scores").alias("bins"))
    counted = s.join(F.broadcast(total))  # one row
    place = lambda k: (F.col("all") - 1) * k / F.col("bins")
    row_at = lambda i: F.min(F.when(F.col("before") + F.col("n") > i, F.col("p")))
    found = counted.groupBy("all", "bins").agg(*[row_at(F.floor(place(k))).alias(f"a{k}") for k in range(most + 1)], *[row_at(F.least(F.floor(place(k)) + 1, F.col("all") - 1)).alias(f"b{k}") for k in range(most + 1)])
    edge = lambda k: F.when(F.col("bins") >= k, F.col(f"a{k}") + (F.col(f"b{k}") - F.col(f"a{k}")) * (place(k) - F.floor(place(k))))
    edges = found.select(F.array_sort(F.array_distinct(F.array_compact(F.array(*[edge(k) for k in range(most + 1)])))).alias("edges"))
    placed = s.join(F.broadcast(edges)).withColumn("bin", F.size(F.filter("edges", lambda e: (e > F.get("edges", F.lit(0))) & (e < F.col("p")))).cast("long"))
    n = F.sum("n")
    return placed.groupBy("bin").agg(n.alias("n"), (F.sum(F.col("p") * F.col("n")) / n).alias("mean_score"), (F.sum("pos") / n).alias("mean_outcome"))


def calibration(bins: DataFrame) -> DataFrame:
    """ece, reliability, resolution, uncertainty from reliability bins."""
    n = F.sum("n")
    base = F.sum(F.col("n") * F.col("mean_outcome")) / n
    sums = bins.agg(
        (F.sum(F.col("n") * F.abs(F.col("mean_score") - F.col("mean_outcome"))) / n).alias("ece"),
        (F.sum(F.col("n") * F.pow(F.col("mean_score") - F.col("mean_outcome"), 2)) / n).alias("reliability"),
        (F.sum(F.col("n") * F.pow("mean_outcome", F.lit(2))) / n).alias("sq"),
        base.alias("base"),
    )
    return sums.select("ece", "reliability", (F.col("sq") - F.col("base") * F.col("base")).alias("resolution"), (F.col("base") * (1 - F.col("base"))).alias("uncertainty"))


def of_key(keys: list[str]) -> tuple[list[Column], Column]:
    """keys under other names, and the condition that they are the same, null with null."""
    same = F.lit(True)
    for i, k in enumerate(keys):
        same &= F.col(k).eqNullSafe(F.col(f"__of_{i}"))
    return [F.col(k).alias(f"__of_{i}") for i, k in enumerate(keys)], same


def centred_ranks(counts: DataFrame, keys: list[str], value: str) -> DataFrame:
    """counts (keys, value, n) with d: twice the average rank of the value in its key less the key's mean rank, a whole number."""
    s = running(counts, F.struct(*keys, value), below=F.col("n"))
    own, same = of_key(keys)
    spans = s.groupBy(*own).agg(F.min("below").alias("__first"), F.sum("n").alias("__all"))
    return s.join(spans, same).select(*counts.columns, (2 * (F.col("below") - F.col("__first")) + F.col("n") - F.col("__all")).cast("double").alias("d"))


def spearman(rows: DataFrame, keys: list[str], a: str, b: str) -> DataFrame:
    """rho: the correlation of average ranks, null where a side has one value only; null values are one value, the lowest.

    Ranks are running counts of a key's distinct values by ranges, so no task holds a key. Rows meet the ranks of
    `a`, which should have the fewer values, and are summed by the value of `b`, whose ranks meet these sums.
    """
    first = centred_ranks(rows.groupBy(*keys, F.col(a).alias("a")).agg(F.count(F.lit(1)).alias("n")), keys, "a")
    own, same = of_key(keys)
    first_ranks = first.select(*own, F.col("a").alias("__a"), "d")
    if first_ranks.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST:
        first_ranks = F.broadcast(first_ranks)
    met = rows.select(*keys, F.col(a).alias("a"), F.col(b).alias("b")).join(first_ranks, same & F.col("a").eqNullSafe(F.col("__a")))
    second = centred_ranks(met.groupBy(*keys, "b").agg(F.count(F.lit(1)).alias("n"), F.sum("d").alias("across")), keys, "b")
    square = F.sum(F.col("n") * F.col("d") * F.col("d"))
    own_squares = first.groupBy(*own).agg(square.alias("__aa"))
    sums = second.groupBy(*keys).agg(F.sum(F.col("d") * F.col("across")).alias("__ab"), square.alias("__bb"))
    return sums.join(own_squares, same).select(*keys, (F.col("__ab") / F.nullif(F.sqrt("__aa") * F.sqrt("__bb"), F.lit(0.0))).alias("rho"))


def upper_median(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """upper_median: the element at floor(n / 2) of a key's sorted values, the larger middle one for an even count.

    Equal values are counted first, so that what a key gathers is its distinct values, by a window that spills.
    """
    counts = rows.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("v")).agg(F.count(F.lit(1)).alias("k"))
    w = Window.partitionBy(*keys)
    placed = counts.select("*", F.sum("k").over(w.orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow)).alias("upto"), F.sum("k").over(w).alias("n"))
    return placed.where((F.col("upto") > F.floor(F.col("n") / 2)) & (F.col("upto") - F.col("k") <= F.floor(F.col("n") / 2))).select(*keys, F.col("v").alias("upper_median"))


def breakeven(value: str) -> Column:
    """Win rate at which expectancy is zero, from the mean win and the mean loss."""
    win, loss = F.avg(F.when(F.col(value) > 0, F.col(value))), F.avg(F.when(F.col(value) <= 0, -F.col(value)))
    return loss / (win + loss)


def best_rule(rows: DataFrame, keys: list[str], rule: str, value: str, least: int) -> DataFrame:
    """The rule with the highest mean among those with `least` rows; ties go to the first by name."""
    means = rows.groupBy(*keys, rule).agg(F.avg(value).alias("mean"), F.count(value).alias("n")).where(F.col("n") >= least)
    w = Window.partitionBy(*keys).orderBy(F.col("mean").desc(), rule)
    return means.select("*", F.row_number().over(w).alias("__r")).where("__r = 1").drop("__r")
