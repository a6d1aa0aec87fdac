from pyspark.sql import functions as F

from candlewick.sources import candles
from candlewick.streaming import live


def test_stream_equals_batch(spark, tmp_path):
    src, table, check = (str(tmp_path / x) for x in ("in", "table", "check"))
    rows = [("x", "S", "1h", t, 1.0, 2.0, 0.5, float(t + q), 1.0, q) for q in range(3) for t in range(5)]
    for i in range(0, 15, 5):
        spark.createDataFrame(rows[i : i + 5], candles.SCHEMA + ", ingest_seq long").coalesce(1).write.mode("append").parquet(src)
        q = live.upsert_stream(live.landing(spark, src, 1), table, check)
        q.awaitTermination()
    got = sorted((r.timestamp, r.close) for r in live.current(spark, table).collect())
    assert got == [(t, float(t + 2)) for t in range(5)]
    assert live.current(spark, str(tmp_path / "none")) is None


def test_closed_candles_by_watermark(spark, tmp_path):
    e = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select(F.col("ts").cast("timestamp").alias("ts"), "event_id", "event_type", "value")
    e.coalesce(1).write.parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema(e.schema).parquet(str(tmp_path / "e"))
    q = live.closed_candles(stream, "4 hours").writeStream.format("memory").queryName("closed").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    got = {(r.symbol, r.timestamp): (r.open, r.high, r.low, r.close, r.volume) for r in spark.table("closed").collect()}
    want = {(r.symbol, r.timestamp): (r.open, r.high, r.low, r.close, r.volume) for r in candles.from_events(spark, "/root/testdata/sf0.001", "4h").collect()}
    assert got and all(want[k] == v for k, v in got.items())
    newest = max(t for _, t in want)
    assert all(t < newest for _, t in got)


def test_new_data_trigger(spark, tmp_path):
    src = str(tmp_path / "in")
    seen = []
    for t in (5, 3, 9):
        spark.createDataFrame([(t,)], "timestamp long").coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema("timestamp long").option("maxFilesPerTrigger", 1).parquet(src)
    live.on_new_data(stream, lambda batch, newest: seen.append(newest), str(tmp_path / "c")).awaitTermination()
    assert seen == sorted(set(seen)) and seen[-1] == 9
