"""Connected components of a graph that stays distributed."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftline.llm.common import checkpointed, release


def components(edges: DataFrame, most_rounds: int = 40, settle: bool = True) -> DataFrame:
    """node, root (the least node of its component) of every node of `edges` (columns a, b).

    In each round every node points to the least of its smaller neighbours, its other smaller
    neighbours are linked to that one instead, and then it points to where that one points, until
    all point to a root; rounds grow with the logarithm of the longest path. A node is grouped
    with its smaller neighbours only; roots of many nodes meet those in an ordinary join, whose
    large partitions adaptive execution splits. Without `settle` it ends after `most_rounds`,
    where equal roots mean one component, but different ones may too. Nulls are no nodes; no
    edges give no rows.
    """
    current = edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    current = current.coalesce(int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    neighbours = Window.partitionBy("a").orderBy("b")
    for number in range(1, most_rounds + 1):
        grouped = current.repartition("a").select("a", "b", F.first("b").over(neighbours).alias("least"), F.row_number().over(neighbours).alias("place"))
        pointers = grouped.where("place = 1").select("a", "b", F.lit(True).alias("points"))
        others = grouped.where("place > 1 AND b <> least").select(F.col("b").alias("a"), F.col("least").alias("b"), F.lit(False).alias("points")).distinct()
        found = checkpointed(pointers.unionByName(others))
        ahead = found.where("points").select(F.col("a").alias("b"), F.col("b").alias("root"))
        jumped = found.join(ahead, "b", "left")
        current = jumped.select("a", F.coalesce("root", "b").alias("b"))
        if jumped.where("NOT points OR root IS NOT NULL").isEmpty() or (number == most_rounds and not settle):
            break
    else:
        raise RuntimeError("components did not settle")
    release(edges.sparkSession)
    pointing = found.where("points").select(F.col("a").alias("node"), F.col("b").alias("root"))
    return pointing.unionByName(found.where("points").select(F.col("b").alias("node")).distinct().join(pointing.select("node"), "node", "left_anti").select("node", F.col("node").alias("root")))
