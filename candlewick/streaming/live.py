"""Structured Streaming counterparts: candle upserts from a landing folder, closed candles by watermark, and the triggered loop."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from candlewick.sources.candles import SCHEMA, upserted


def landing(spark: SparkSession, path: str, files: int = 100) -> DataFrame:
    """Candles that arrive as Parquet files, with the batch's order as ingest_seq in the column of that name."""
    return spark.readStream.schema(SCHEMA + ", ingest_seq long").option("maxFilesPerTrigger", files).parquet(path)


#: The table's parts; a batch rewrites those that its series fall into.
PARTS = 64


def upsert_stream(stream: DataFrame, table: str, checkpoint: str) -> StreamingQuery:
    """Merges every micro-batch into the table: the highest ingest_seq of a key wins, however late it comes, and replays change nothing.

    Each batch writes the parts that it touches beside the old ones, and then notes that they are the newest, so a lost batch leaves the table
    as it was. vacuum() removes parts that newer ones have replaced.
    """

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        part = F.pmod(F.xxhash64("exchange", "symbol", "timeframe"), F.lit(PARTS)).cast("int")
        new = batch.withColumn("ingest_seq", F.coalesce("ingest_seq", F.lit(number)))
        touched = sorted(r.part for r in new.select(part.alias("part")).distinct().collect())
        if not touched:
            return
        before = current(spark, table, touched)
        merged = upserted(before if before is not None else new.limit(0), new, keep=True)
        merged.withColumn("part", part).write.mode("overwrite").partitionBy("part").parquet(f"{table}/v{number}")
        spark.createDataFrame([(number, p) for p in touched], "version long, part int").coalesce(1).write.mode("append").json(f"{table}/_versions")

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _newest(spark: SparkSession, table: str) -> dict[int, int]:
    """The newest version of each part (PARTS of them at most)."""
    try:
        rows = spark.read.schema("version long, part int").json(f"{table}/_versions").groupBy("part").agg(F.max("version").alias("v")).collect()
    except Exception as e:  # no version yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return {}
    return {r.part: r.v for r in rows}


def current(spark: SparkSession, table: str, parts: list[int] | None = None) -> DataFrame | None:
    """The table's candles with their ingest_seq (of some parts); None if there are none."""
    paths = [f"{table}/v{v}/part={p}" for p, v in sorted(_newest(spark, table).items()) if parts is None or p in parts]
    return spark.read.schema(SCHEMA + ", ingest_seq long").parquet(*paths) if paths else None


def vacuum(spark: SparkSession, table: str) -> int:
    """Removes parts that were replaced before the newest batch, and returns how many; readers of the last two batches' tables aren't disturbed."""
    newest, gone = _newest(spark, table), 0
    last = max(newest.values(), default=0)
    every = spark.read.schema("version long, part int").json(f"{table}/_versions").distinct().collect() if newest else []
    for r in every:
        later = min((x.version for x in every if x.part == r.part and x.version > r.version), default=None)
        if later is not None and later < last:
            path = spark._jvm.org.apache.hadoop.fs.Path(f"{table}/v{r.version}/part={r.part}")
            gone += bool(path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True))
    return gone


def closed_candles(events: DataFrame, timeframe: str = "5 minutes", late: str = "0 seconds") -> DataFrame:
    """Candles of an event stream (ts, event_id, event_type, value) that appear once their time has passed the watermark."""
    order = F.struct("ts", "event_id")
    made = events.withWatermark("ts", late).groupBy(F.window("ts", timeframe), "event_type").agg(
        F.min_by("value", order).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", order).alias("close"), F.count(F.lit(1)).cast("double").alias("volume")
    )
    return made.select(F.col("event_type").alias("symbol"), F.unix_millis(F.col("window.start")).alias("timestamp"), "open", "high", "low", "close", "volume")


def on_new_data(stream: DataFrame, run: Callable[[DataFrame, int], None], checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Calls run(batch, newest timestamp) for micro-batches that go beyond all earlier ones; the newest time is noted before it runs, beside the
    checkpoint, so a restart goes on from there."""
    noted = f"{checkpoint.rstrip('/')}-newest"

    def step(batch: DataFrame, number: int) -> None:
        spark, newest = batch.sparkSession, batch.agg(F.max("timestamp")).first()[0]
        if newest is not None and newest > newest_seen(spark, noted):
            note_newest(spark, noted, newest)
            run(batch, newest)

    writer = stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def newest_seen(spark: SparkSession, noted: str) -> int:
    try:
        found = spark.read.schema("newest long").json(noted).agg(F.max("newest")).first()[0]
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return -1
    return -1 if found is None else found


def note_newest(spark: SparkSession, noted: str, newest: int) -> None:
    spark.createDataFrame([(newest,)], "newest long").coalesce(1).write.mode("append").json(noted)


def poll(cycle: Callable[[int], None], max_cycles: int | None = None, pause: float = 60.0, failed: Callable[[int, Exception], None] | None = None, sleep: Callable[[float], None] = time.sleep) -> int:
    """Calls cycle(number) again and again, `max_cycles` times or for ever; the number of cycles that went well.

    A cycle that fails is handed to `failed`, and the next one goes on.
    """
    number = well = 0
    while max_cycles is None or number < max_cycles:
        try:
            cycle(number)
            well += 1
        except Exception as e:  # the loop outlives any cycle
            if failed is not None:
                failed(number, e)
        number += 1
        if max_cycles is None or number < max_cycles:
            sleep(pause)
    return well
