"""Session construction: one place for the settings every entry point relies on."""

from __future__ import annotations

import gc
import os
import tempfile
from contextlib import suppress

import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "driftline", master: str | None = None, **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution; `conf` overrides any setting.

    `spark.sql.shuffle.partitions` is only the initial number: adaptive execution coalesces it,
    so it is set generously and a cluster deployment passes its own.
    """
    cpus = os.environ.get("BENCH_CPUS", "8")
    builder = SparkSession.builder.appName(app).master(master or f"local[{cpus}]")
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.shuffle.partitions": cpus,
        "spark.driver.memory": "8g",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    } | conf
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder that `spark.checkpoint.dir` names, which driver and executors share.

    Only a local session without that setting (tests, a laptop) gets a folder of its own; on a
    cluster the setting is required.
    """
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir")
    if named:
        return named
    if not context._jsc.sc().getCheckpointDir().isDefined():
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="driftline-checkpoint-"))
    return context._jsc.sc().getCheckpointDir().get()


def checkpointed(df: DataFrame) -> DataFrame:
    """`df` computed once, its lineage cut through the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def release(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files and checkpoints of finished steps.

    It does so when their handles on the driver are collected, which an idle driver puts off for up
    to half an hour; an operator of many rounds calls this between them, so that disk holds a round and not all.
    Memory that the driver no longer uses goes back too: Arrow's, and what the C library keeps of the JVM's
    compilers, collectors and threads.
    """
    gc.collect()
    pa.default_memory_pool().release_unused()
    jvm = spark.sparkContext._jvm
    jvm.System.gc()
    trim_native(spark)


def trim_native(spark: SparkSession) -> None:
    """Has the JVM of the driver return native memory that it has freed, by the command that `jcmd` calls System.trim_native_heap; JVMs without it are left as they are."""
    jvm = spark.sparkContext._jvm
    call = next(m for m in jvm.java.lang.Class.forName("javax.management.MBeanServer").getMethods() if m.getName() == "invoke")  # the server's own class is not public
    given = spark.sparkContext._gateway.new_array(jvm.Object, 4)  # of four the last two, arguments and their types, stay null
    given[0], given[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
    with suppress(Py4JJavaError):
        call.invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), given)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder that this program wrote, in whatever file system it is."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
