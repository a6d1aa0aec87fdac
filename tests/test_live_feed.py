"""The live feed as a streaming source, and closed candles by keyed state: restarts, faults, late and repeated rows give what a batch gives."""

import json
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from candlewick.sources import candles, live_feed
from candlewick.streaming import bars, live

HOUR, HERE = 3_600_000, Path(__file__).parent


@pytest.fixture
def service(spark, monkeypatch):
    monkeypatch.syspath_prepend(str(HERE))
    spark.dataSource.register(live_feed.LiveCandles)
    import feed_service

    yield lambda **state: feed_service.STATE.write_text(json.dumps(state))
    feed_service.STATE.unlink(missing_ok=True)


def feed(spark, **options):
    given = dict(fetch=f"{HERE}/feed_service.py:fetch", clock=f"{HERE}/feed_service.py:clock", exchanges="a,b", symbols="A/U,B/U", timeframes="1h,4h", pause="0.01", tries="2", patience="0.1")
    return spark.readStream.format("live_candles").options(**{**given, **options}).load()


def test_restarted_stream_equals_the_batch(spark, service, tmp_path):
    table, checkpoint, turns = str(tmp_path / "t"), str(tmp_path / "c"), []
    for state in ({"now": 10 * HOUR + 3000}, {"now": 31 * HOUR, "down": ["a"]}, {"now": 31 * HOUR + 1000}, {"now": 45 * HOUR + 2500, "lacking": [44 * HOUR]}, {"now": 46 * HOUR + 9000}):
        service(**state)
        stream = feed(spark).withColumn("exchange", F.lit("x")).withColumn("ingest_seq", F.lit(None).cast("long"))
        live.upsert_stream(stream, table, checkpoint).awaitTermination()
        got = live.current(spark, table)
        turns.append({(r.symbol, r.timeframe, r.timestamp): r.close for r in got.collect()})
    hours = lambda end, skip=(): {(s, "1h", t * HOUR): t + 0.5 for s in ("A/U", "B/U") for t in range(end) if t not in skip}
    fours = lambda end: {(s, "4h", t * 4 * HOUR): t + 0.5 for s in ("A/U", "B/U") for t in range(end // 4)}
    assert turns[0] == hours(10) | fours(10)
    assert turns[1] == hours(30) | fours(30) == turns[2]  # the 31st hour ended less than 2.5 s ago
    assert turns[3] == hours(45, (44,)) | fours(44)
    assert turns[4] == hours(46) | fours(44)  # the late candle came with the next range


def test_a_service_that_is_down_loses_nothing(spark, service, tmp_path):
    table, checkpoint = str(tmp_path / "t"), str(tmp_path / "c")
    service(now=9 * HOUR + 3000, down=["a", "b"])
    made = lambda: live.upsert_stream(feed(spark, timeframes="1h").withColumn("ingest_seq", F.lit(None).cast("long")), table, checkpoint)
    with pytest.raises(Exception):  # noqa: B017 -- the stream ends with what its reader raised
        made().awaitTermination()
    service(now=12 * HOUR + 3000)
    made().awaitTermination()
    assert live.current(spark, table).count() == 18  # the lost batch runs again, with its own range
    made().awaitTermination()
    assert live.current(spark, table).count() == 24


def test_partitions_cover_new_series_and_gaps():
    reader = live_feed.LiveReader({"symbols": "A/U,B/U", "timeframes": "1h", "since": str(HOUR // 2), "backfill": "2"})
    assert reader.initialOffset() == {"A/U|1h": HOUR, "B/U|1h": HOUR}
    got = [p.value for p in reader.partitions({"A/U|1h": 10 * HOUR}, {"A/U|1h": 12 * HOUR, "B/U|1h": 12 * HOUR})]
    assert got == [("A/U", "1h", 8 * HOUR, 12 * HOUR), ("B/U", "1h", HOUR, 12 * HOUR)]
    assert reader.partitions({"A/U|1h": 5 * HOUR, "B/U|1h": 5 * HOUR}, {"A/U|1h": 5 * HOUR, "B/U|1h": 5 * HOUR}) == []


def listed(df):
    return sorted((tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.collect()), key=str)


def test_state_equals_batch(spark, tmp_path):
    """Rows come in shuffled batches, some late, some twice with other sequences, some never; the query stops and starts between batches."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rng, rows = np.random.default_rng(6), []
    for symbol in ("A", "B"):
        for i in range(60):
            if i not in (7, 8, 9, 30):
                for q in range(int(rng.integers(1, 4))):
                    o, c, x = (float(v) for v in rng.random(3))
                    rows.append(("e", symbol, "1h", (240 + i) * HOUR, o, max(o, c) + x, min(o, c) - x, c, float(i + q), int(rng.integers(0, 3))))
    rows.sort(key=lambda r: r[3] + int(rng.integers(0, 5)) * HOUR)  # five hours late at most
    src, out, checkpoint = (str(tmp_path / x) for x in ("in", "out", "c"))
    schema = candles.SCHEMA + ", ingest_seq long"
    for i in range(0, len(rows), 40):
        spark.createDataFrame(rows[i : i + 40], schema).coalesce(1).write.mode("append").parquet(src)
        stream = bars.closed_bars(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src), "1h", ["1h", "4h", "1d"], "6 hours")
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    newest = max(r[3] for r in rows)
    got = spark.read.schema(bars.SCHEMA).parquet(out)
    want = bars.batch_bars(spark.createDataFrame(rows, schema), "1h", ["1h", "4h", "1d"], newest - 6 * HOUR).select(got.columns)
    a, b = listed(got), listed(want)
    assert a == b, (sorted(set(a) - set(b), key=str)[:6], sorted(set(b) - set(a), key=str)[:6], len(a), len(b), newest // HOUR)
    assert {r.kind for r in got.collect()} == {"candle", "gap"}
    assert got.where("timeframe = '1d' AND missing > 0").count() > 0
    with pytest.raises(ValueError, match="multiples"):
        bars.Bars("4h", ["1h"])
