"""Session defaults and the shared scratch folder."""

from __future__ import annotations

import atexit
import contextlib
import gc
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Settings every session of this library wants; the caller's own win.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, memory: str = "8g", **conf: str) -> SparkSession:
    """A local session for tests and benchmarks; clusters bring their own."""
    b = SparkSession.builder.master(f"local[{cores}]").config("spark.driver.memory", memory)
    for k, v in (DEFAULTS | {"spark.sql.shuffle.partitions": str(shuffle_partitions)} | conf).items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see.

    It is what spark.checkpoint.dir names. Only in local sessions (tests), where that is unset, a folder of this machine is made and set;
    a cluster's executors wouldn't see it.
    """
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        named = spark.sparkContext._jsc.sc().getCheckpointDir()
        named = named.get() if named.isDefined() else None
    if not named and not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors see")
    if not named:
        named = "file://" + tempfile.mkdtemp(prefix="candlewick-")
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder; removed when the driver's interpreter ends."""
    path = f"{shared_dir(spark)}/candlewick-{label}-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    return path


def _remove(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):  # the JVM may be gone; the folder's owner then clears it
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def release(spark: SparkSession) -> None:
    """Lets go of memory between the steps of a long job.

    Spark's cleaner removes the shuffle files of steps whose results are written once the driver's JVM has collected what refers to them.
    Executors collect too, as their heaps, and native buffers that only a collection frees, else stay as large as the largest step made
    them while the next step's Python workers need the room. It costs a collection, and a job of empty tasks.
    """
    gc.collect()
    spark._jvm.System.gc()
    if not spark.sparkContext.master.startswith("local["):
        n = spark.sparkContext.defaultParallelism
        spark.range(0, n, 1, n).select(F.reflect(F.lit("java.lang.System"), F.lit("gc"))).write.format("noop").mode("overwrite").save()


#: Spark removes a query's shuffle files as soon as the query has ended, instead of when the driver's JVM happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def _cleaned(spark: SparkSession) -> Iterator[None]:
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)


def written(df: DataFrame, label: str) -> DataFrame:
    """The rows of df, cut from their lineage: written as Parquet to the shared folder and read again.

    A lost executor costs a read of that table, not a recomputation. The shuffle files of the query go when it has ended: only the table
    is read afterwards.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    with _cleaned(spark):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch = path
    return out


def discard(*frames: DataFrame) -> None:
    """Removes the tables of frames that written() returned; neither they nor what is derived from them can be read afterwards."""
    for df in frames:
        _remove(df.sparkSession, df.scratch)
