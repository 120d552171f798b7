"""Writes of a stream's batches that change nothing when a batch comes again.

Everything a batch writes lands in a folder that bears its number, overwritten if the batch is
repeated, and is made from folders of lower numbers only. So the same batch twice, or a crash
between two writes of one, leaves what one write would. The folders are the ledger.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.operators import ledger
from driftline.operators.folds import fields
from driftline.session import remove

Batch = Callable[[DataFrame, int], None]


def listed(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the batches that a folder holds whole, in order."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(at):
        return []
    done = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    names = [x.getPath().getName() for x in fs.listStatus(at)]
    return sorted(int(n.removeprefix("batch=")) for n in names if n.startswith("batch=") and fs.exists(done(f"{path}/{n}/_SUCCESS")))


def folder(path: str, batch: int) -> str:
    return f"{path}/batch={batch}"


@dataclass
class Log:
    """Rows that only grow: each batch's folder holds what it added."""

    path: str
    schema: str  # as DDL

    def before(self, spark: SparkSession, batch: int) -> DataFrame:
        """What batches of lower numbers added."""
        parts = [folder(self.path, b) for b in listed(spark, self.path) if b < batch]
        return spark.read.schema(self.schema).parquet(*parts) if parts else spark.createDataFrame([], self.schema)

    def read(self, spark: SparkSession) -> DataFrame:
        return self.before(spark, 1 << 62)

    def write(self, rows: DataFrame, batch: int) -> DataFrame:
        rows.write.mode("overwrite").parquet(folder(self.path, batch))
        return rows.sparkSession.read.schema(self.schema).parquet(folder(self.path, batch))


@dataclass
class Table:
    """Rows that change: each batch's folder holds the whole table after it; the last `keep` are kept."""

    path: str
    schema: str  # as DDL
    keep: int = 2

    def before(self, spark: SparkSession, batch: int) -> DataFrame:
        """The table as it was before a batch."""
        old = [b for b in listed(spark, self.path) if b < batch]
        return spark.read.schema(self.schema).parquet(folder(self.path, old[-1])) if old else spark.createDataFrame([], self.schema)

    def read(self, spark: SparkSession) -> DataFrame:
        return self.before(spark, 1 << 62)

    def write(self, rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(folder(self.path, batch))
        for old in [b for b in listed(rows.sparkSession, self.path) if b <= batch][: -self.keep]:
            remove(rows.sparkSession, folder(self.path, old))


def new_rows(log: Log, rows: DataFrame, batch: int, keys: list[str], order: list[str]) -> DataFrame:
    """Insert-ignore: of each key that no earlier batch has, this batch's first row by `order`; those rows, as written."""
    others = [c for c in fields(log.schema) if c not in keys]
    first = rows.groupBy(*keys).agg(F.min_by(F.struct(*others), F.struct(*order)).alias("s")).select(*keys, "s.*").select(*fields(log.schema))
    return log.write(first.join(log.before(rows.sparkSession, batch).select(*keys), keys, "left_anti").select(*fields(log.schema)), batch)


def insert_ignore(log: Log, keys: list[str], order: list[str]) -> Batch:
    """A sink in which the first row of a key stays."""

    def write(rows: DataFrame, batch: int) -> None:
        new_rows(log, rows, batch, keys, order)

    return write


def insert_with_seen(log: Log, seen: Table, keys: list[str], order: list[str], groups: list[str], first_too: bool = True) -> Batch:
    """Insert-ignore, and from the rows that were new alone each group's first and last time (`at`) in a second table.

    Without `first_too` a group that is known keeps its first time, whatever comes (hints).
    """

    def write(rows: DataFrame, batch: int) -> None:
        spark = rows.sparkSession
        new = ledger.seen(new_rows(log, rows, batch, keys, order), groups)
        old = seen.before(spark, batch)
        if first_too:
            merged = ledger.merge_seen(old, new, groups)
        else:
            both = old.withColumn("__known", F.lit(0)).unionByName(new.withColumn("__known", F.lit(1)))
            merged = both.groupBy(*groups).agg(F.min_by("first_seen", F.struct("__known", "first_seen")).alias("first_seen"), F.max("last_seen").alias("last_seen"))
        seen.write(merged.select(*fields(seen.schema)), batch)

    return write


def upsert(table: Table, keys: list[str], order: str) -> Batch:
    """A sink in which the last row of a key by `order` stays; `order` should settle ties."""

    def write(rows: DataFrame, batch: int) -> None:
        names = fields(table.schema)
        table.write(ledger.upsert(table.before(rows.sparkSession, batch), rows.select(*names), keys, order).select(*names), batch)

    return write


def run(frame: DataFrame, write: Batch, checkpoint: str) -> None:
    """All that a stream has now through a sink."""
    frame.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
