"""Pattern records end to end, training with artefacts, policies, and the parts of the live loop."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from candlewick.operators import backtest, records, training
from candlewick.session import written
from candlewick.sources import candles
from candlewick.streaming import live

HOUR = 3_600_000


@pytest.fixture(scope="module")
def walk(spark):
    """A random walk's hourly candles, and the four-hour and daily ones of the same path."""
    rng = np.random.default_rng(12)
    close = 100 * np.exp(np.cumsum(rng.normal(0, 0.006, 5000)))
    rows = []
    for name, k in (("1h", 1), ("4h", 4), ("1d", 24)):
        for i in range(0, len(close) - k + 1, k):
            part = close[max(i - 1, 0) : i + k]
            rows.append(("local", "A/B", name, i * HOUR, float(part[0]), float(part.max() + rng.random() * 0.2), float(part.min() - rng.random() * 0.2), float(part[-1]), float(50 + rng.random() * 100)))
    return spark.createDataFrame(rows, candles.SCHEMA)


@pytest.fixture(scope="module")
def built(walk):
    return written(records.build(walk, ["1d", "4h"]), "records")


def test_records(walk, built):
    assert built.columns == records.COLUMNS
    rows = built.collect()
    keys = {(r.timeframe, r.timestamp, r.pattern_type) for r in rows}
    assert len(keys) == len(rows) and {r.timeframe for r in rows} == {"1d", "4h"}
    assert any(r.pattern_type.startswith(("Double", "Triple", "Rounded", "Channels")) for r in rows) and any(r.pattern_type == "Doji" for r in rows)
    n_daily = walk.where("timeframe = '1d'").count()
    for r in rows:
        assert len(r.embedding) == 64 and abs(sum(x * x for x in r.embedding) - 1) < 1e-9
        g = r.geometry_metrics
        raw = [g.get(k) or 0.0 for k in ("confidence_breakout", "symmetry_score", "curvature_mean", "slope_mean", "shape_dtw_to_u", "shape_dtw_to_invu", "height_tolerance", "depth_tolerance")]
        raw += [r.volatility_context.atr_percent, {"low": 0.0, "high": 1.0}.get(r.volatility_context.regime, 0.5)]
        raw += ([r.detector_features[k] for k in sorted(r.detector_features)][:10] + [0.0] * 10)[:10]
        places = [i for i, x in enumerate(r.embedding[:24]) if x > 0]
        size = math.sqrt(len(places) + sum(x * x for x in raw))
        assert np.allclose(r.embedding[24:44], np.array(raw) / size, atol=1e-9) and r.embedding[44:] == [0.0] * 20
        assert r.label in ("Good", "Bad", "Neutral") and set(r.forward_returns) in ({"1h", "4h", "24h"}, set())
        assert r.timeframe == "4h" or 0 <= r.timestamp < n_daily * 24 * HOUR
    daily = [r for r in rows if r.timeframe == "1d"]
    raised = [r for r in daily if r.confidence > r.geometry_metrics["confidence_breakout"] + 1e-9]
    assert raised and all(min(1.0, r.geometry_metrics["confidence_breakout"] * 1.1) <= r.confidence + 1e-9 for r in raised)


def test_training_policies_and_comparison(spark, walk, built, tmp_path):
    four = written(built.where("timeframe = '4h'"), "four")
    scores = training.train(four, str(tmp_path / "m"), cap=400)
    assert 0 <= scores["val_accuracy"] <= 1 and scores["val_return_mae"] >= 0
    training.train(four, str(tmp_path / "s"), cap=400, length=4, stride=1)
    model, sequence = training.load(spark, str(tmp_path / "m")), training.load(spark, str(tmp_path / "s"))
    assert model.meta["num_samples"] <= 400 and sequence.meta["length"] == 4 and model.meta["metrics"] == scores
    p = model.scored(four.select("timestamp", "pattern_type", "embedding")).select("p", "expected").collect()
    assert len(p) == four.count() and all(0 <= r.p <= 1 and math.isfinite(r.expected) for r in p)
    with pytest.raises(ValueError, match="few rows"):
        training.train(four.limit(6), str(tmp_path / "x"))
    with pytest.raises(ValueError, match="no Good"):
        training.rows_of(four.where("label = 'Neutral'"))
    store = four.withColumn("record_id", F.xxhash64("timestamp", "pattern_type"))
    cfg = backtest.BacktestConfig(eval_fraction=0.9, min_confidence=0.5, p_long=0.5, p_short=0.5)
    policies = {"model": training.model_policy(model, cfg), "sequence": training.sequence_policy(sequence, cfg), "similarity": training.similarity_policy(store, 10, cfg)}
    found, taken, curve = training.compare(four, walk.where("timeframe = '1h'"), policies, cfg, max_events=40)
    got = {r.policy: r for r in found.collect()}
    assert set(got) == set(policies) and sorted(r.place for r in got.values()) == [1, 2, 3]
    assert sum(r.trade_count for r in got.values()) > 0 and taken.groupBy("policy").count().agg(F.max("count")).first()[0] <= 40
    late = four.agg(F.expr("CAST(percentile(timestamp, 0.9D) AS bigint)")).first()[0]
    assert taken.agg(F.min("timestamp")).first()[0] >= late and curve.where("number = 0").count() == 3


def test_rows_without_any_class_are_too_few(built, tmp_path):
    """Whichever six rows a limit gives: an error of the same kind."""
    with pytest.raises(ValueError, match="few rows"):
        training.train(built.where("label = 'Neutral'").limit(6), str(tmp_path / "x"))


def test_late_row_with_a_lower_sequence_loses(spark, tmp_path):
    src, table = str(tmp_path / "in"), str(tmp_path / "t")
    for i, (close, q) in enumerate([(1.0, 5), (2.0, 3), (3.0, 6), (4.0, 6)]):
        spark.createDataFrame([("x", f"S{i % 2}", "1h", 0, 1.0, 9.0, 0.5, close, 1.0, q), ("x", "T", "1h", 0, 1.0, 9.0, 0.5, close, 1.0, q)], candles.SCHEMA + ", ingest_seq long").coalesce(1).write.mode("append").parquet(src)
        live.upsert_stream(live.landing(spark, src, 1), table, str(tmp_path / "c")).awaitTermination()
    want = {"S0": 3.0, "S1": 4.0, "T": 4.0}
    assert {r.symbol: r.close for r in live.current(spark, table).collect()} == want
    assert live.vacuum(spark, table) >= 1 and {r.symbol: r.close for r in live.current(spark, table).collect()} == want


def test_trigger_goes_on_after_a_restart(spark, tmp_path):
    src, seen = str(tmp_path / "in"), []
    for turn, t in enumerate((9, 5, 12)):
        spark.createDataFrame([(t,)], "timestamp long").coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema("timestamp long").parquet(src)
        live.on_new_data(stream, lambda batch, newest: seen.append(newest), str(tmp_path / "c")).awaitTermination()
    assert seen == [9, 12] and turn == 2


def test_poll_outlives_failures():
    ran, failures = [], []

    def cycle(i):
        ran.append(i)
        if i == 1:
            raise OSError("gone")

    assert live.poll(cycle, 4, 0, lambda i, e: failures.append((i, str(e))), sleep=lambda s: None) == 3
    assert ran == [0, 1, 2, 3] and failures == [(1, "gone")]


def test_scan_tells_symbols_apart(spark, tmp_path):
    rows = [("x", s, "1w", t, 1.0, 1.0, 1.0, float(len(s)), 1.0) for s in ("A/B", "A_B") for t in (0, 7 * 24 * HOUR)]
    df = spark.createDataFrame(rows, candles.SCHEMA)
    candles.store(df, str(tmp_path))
    assert [r.symbol for r in candles.scan(spark, str(tmp_path), "x", "A/B", "1w").collect()] == ["A/B"] * 2
    assert {r.closed_ts for r in candles.closed(df, 8 * 24 * HOUR).collect()} == {0}
