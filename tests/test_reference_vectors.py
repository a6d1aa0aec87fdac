"""Published and hand-made vectors."""

import pytest
from pyspark.sql import functions as F

from candlewick.functions import scalars
from candlewick.operators import backtest, candlestick, chart, geometry, indicators, labeling, simulate, vectors
from candlewick.sources import candles

HOUR = 3_600_000


def _series(spark, rows, symbol="S", timeframe="1h"):
    return spark.createDataFrame([("x", symbol, timeframe, *r) for r in rows], candles.SCHEMA)


def test_decode_upsert_validate(spark):
    raw = spark.createDataFrame([('[1710000000000,"60000","61000","59000","60500","123.4"]',)], "p string")
    r = candles.decoded(raw, "p", "binance", "BTC/USDT", "1h").first()
    assert (r.timestamp, r.open, r.close, r.volume) == (1710000000000, 60000.0, 60500.0, 123.4)
    a = _series(spark, [(1, 1.0, 1.0, 1.0, 60500.0, 10.0)])
    b = _series(spark, [(1, 1.0, 1.0, 1.0, 60600.0, 11.0)])
    got = candles.upserted(a, b).collect()
    assert len(got) == 1 and (got[0].close, got[0].volume) == (60600.0, 11.0)
    two = _series(spark, [(2, 1.0, 1.0, 1.0, 1.0, 1.0), (1, 1.0, 1.0, 1.0, 1.0, 1.0)])
    assert [r.timestamp for r in candles.validated(two).collect()] == [1, 2]


def test_store_and_scan(spark, tmp_path):
    df = _series(spark, [(i, 1.0, 1.0, 1.0, float(i), 1.0) for i in range(5)], "BTC/USDT")
    candles.store(df, str(tmp_path / "c"))
    candles.store(_series(spark, [(9, 1.0, 1.0, 1.0, 9.0, 1.0)], "ETH/USDT"), str(tmp_path / "c"))
    got = candles.scan(spark, str(tmp_path / "c"), "x", "BTC/USDT", "1h", 1, 3)
    assert [r.timestamp for r in got.collect()] == [1, 2, 3]
    assert candles.exists(df, "x", "BTC/USDT", "1h") and not candles.exists(df, "x", "BTC/USDT", "4h")


def test_doji(spark):
    close = [100, 101, 100.5, 100.5, 103, 104]
    rows = []
    for i, c in enumerate(close):
        o = close[i - 1] if i else c
        rows.append([i * HOUR, float(o), float(max(o, c) + 1), float(min(o, c) - 1), float(c), 100.0])
    rows[3][1:5] = [100.5, 105.0, 95.0, 100.5]
    found = {r.pattern_type for r in candlestick.detect(_series(spark, rows)).collect()}
    assert found & {"Doji", "LongLeggedDoji"}


def test_triple_top(spark):
    close = [100.0] * 220
    for top in (50, 100, 150):
        for k in range(-5, 6):
            close[top + k] = 120.0 - abs(k)
    for low in (75, 125):
        for k in range(-5, 6):
            close[low + k] = 95.0 + abs(k)
    close[151], close[152] = 90.0, 89.0
    rows = [(i * HOUR, close[i - 1] if i else close[0], c + 2, c - 2, c, 100.0) for i, c in enumerate(close)]
    got = chart.detect(_series(spark, rows)).collect()
    tops = [r for r in got if r.pattern_type == "TripleTop"]
    assert tops and tops[0].timestamp == 151 * HOUR and 0 < tops[0].confidence <= 0.0201


def test_peaks():
    import numpy as np

    assert chart.peaks(np.array([0, 1, 0, 2, 2, 2, 0, 1.0, 0]), 1, 0.5).tolist() == [1, 4, 7]
    assert chart.peaks(np.array([0, 3.0, 0, 2, 0, 1, 0]), 3, 0).tolist() == [1, 5]
    assert chart.peaks(np.array([0, 1.0, 0.9, 1.1, 0]), 1, 0.2).tolist() == [3]
    assert chart.peaks(np.array([1.0, 1, 1]), 1, 0).tolist() == []


def test_time_correct_labels(spark):
    series = _series(spark, [(i * HOUR, 100.0, 100.0, 100.0, 100.0, 1.0) for i in range(40)])
    inst = spark.createDataFrame([("S", "1h", 0, "T", 0.5), ("S", "1h", 5 * HOUR, "T", 0.5), ("S", "1h", 39 * HOUR, "T", 0.5)], "symbol string, timeframe string, timestamp long, pattern_type string, confidence double")
    got = {r.timestamp: (r.label_score, r.label) for r in labeling.label(inst, series).collect()}
    assert got[5 * HOUR] == (pytest.approx(0.75, abs=1e-9), "Neutral") and got[0] == (pytest.approx(0.5), "Neutral") and got[39 * HOUR] == (0.5, "Neutral")
    has = labeling.next_at_or_after(inst, labeling.forward_returns(series), ["symbol"], ["fwd_1h", "fwd_4h", "fwd_24h"]).where("fwd_1h IS NOT NULL")
    a, b = (sorted(tuple(r) for r in f(has).collect()) for f in (labeling.ranks, labeling.ranks_by_digits))
    assert a == b


def test_hash_vector(spark):
    r = spark.range(1).select(F.expr(scalars.md5_mod24("'Hammer|0'")).alias("h"), F.md5(F.lit("Hammer|0").cast("binary")).alias("m")).first()
    assert (r.h, r.m) == (19, "aaafa58c584864c708243f0334bd57cb")


def test_curve_functions(spark):
    df = spark.range(1).select(F.array(*[F.lit(float(x)) for x in (1, 3, 2, 5)]).alias("a"), F.array(*[F.lit(float(x)) for x in (1, 2, 5)]).alias("b"))
    r = df.select(F.expr(scalars.dtw("a", "b")).alias("d"), F.expr(scalars.resampled("a", 7)).alias("r"), F.expr(scalars.slope_mean("a")).alias("s"), F.expr(scalars.curvature_mean("a")).alias("c")).first()
    assert r.d == 1.0 and r.r == pytest.approx([1, 2, 3, 2.5, 2, 3.5, 5]) and r.s == pytest.approx(4 / 3) and r.c == pytest.approx((3 + 4) / 2)
    flat = spark.range(1).select(F.array_repeat(F.lit(5.0), 49).alias("seg"))
    g = geometry.enriched(flat).first()
    assert (g.curvature_mean, g.slope_mean) == (0.0, 0.0) and g.shape_dtw_to_u > 0


def test_vector_search(spark):
    store = spark.createDataFrame([("a", [1.0, 0.0], "Good"), ("b", [0.0, 1.0], "Bad")], "record_id string, embedding array<double>, label string")
    q = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0])], "query_id long, query array<double>")
    got = vectors.search(q, store, 1).collect()
    assert [(r.query_id, r.record_id) for r in got] == [(1, "a")]
    assert [r.label for r in vectors.search(q, store.where(vectors.conditions(label="Bad", symbol=None)), 5).collect()] == ["Bad"]
    many = vectors.search(spark.range(1, 40).selectExpr("id query_id", "array(1D, double(id)) query"), store, 2, few=7)
    assert many.count() == 78


def test_published_first_trade(spark):
    entry, atr = 122232.21, 69.72928571428618
    bars = [(i * 300_000, entry, entry + 40, entry - 40, entry, 1.0) for i in range(40)]
    bars[21] = (21 * 300_000, entry, entry + 10, entry - 300, entry - 5, 1.0)
    series = _series(spark, bars, timeframe="5m")
    cfg = backtest.BacktestConfig()
    signal = spark.createDataFrame([("p", "S", 20 * 300_000, -1, 0.9)], "policy string, symbol string, timestamp long, direction int, confidence double")
    atr_here = indicators.with_atr(series).where("idx = 20").first().atr
    r = backtest.trades(signal, series, cfg).first()
    sl, tp = entry + 1.5 * 0.85 * atr_here, entry - 2 * 0.9 * atr_here
    assert (r.exit_reason, r.sl_raw, r.tp_raw, r.exit_ts) == ("take_profit", pytest.approx(sl), pytest.approx(tp), 23 * 300_000)
    # The published row, replayed with its own ATR.
    e = entry * (1 - 0.0005)
    qty = min(100 / (entry + 1.275 * atr - e), 10_000 / e)
    x = (entry - 1.8 * atr) * 1.0005
    assert qty == pytest.approx(0.08185242254272114, rel=1e-12) and qty * (e - x) - 0.001 * qty * (e + x) == pytest.approx(-19.72607236320665, rel=1e-9)
    assert r.share == pytest.approx(r.qty * (e - r.exit_eff) - 0.001 * r.qty * (e + r.exit_eff))


def test_no_trades_give_zero_metrics(spark):
    starts = spark.createDataFrame([("p", 5)], "policy string, eval_start long")
    none = spark.createDataFrame([], "policy string, number int, timestamp long, exit_ts long, share double, equity double, net_pnl double")
    r = backtest.metrics(none, backtest.equity_curve(none, starts)).first()
    assert [r[m] for m in backtest.METRICS] == [0.0] * 10 + [0]


def _walk(bars, equity=10_000.0):
    cash, qty, sl, tp, last, out = equity, 0.0, 0.0, 0.0, equity, []
    for i, h, low, c, atr, a in bars:
        hit = None
        if qty:
            hit = sl if low <= sl else tp if h >= tp else None
            if hit is not None:
                cash += qty * hit * 0.9995 * 0.999
                qty = 0.0
        if not qty:
            if a == 1:
                e = c * 1.0005
                q = min(cash * 0.01 / (1.5 * atr), cash / e)
                if q * e * 1.001 <= cash:
                    cash, qty, sl, tp = cash - q * e * 1.001, q, e - 1.5 * atr, e + 2 * atr
        elif a == 2:
            cash += qty * c * 0.9995 * 0.999
            qty = 0.0
        now = cash + qty * c
        out.append((i, now, cash, qty > 0, (now - last) / equity))
        last = now
        if now <= equity * 0.9:
            break
    return out


def test_environment_equals_a_walk(spark):
    import random

    rng = random.Random(0)
    bars, c = [], 100.0
    for i in range(200):
        c = max(5.0, c + rng.uniform(-3, 3))
        bars.append((i, c + rng.random() * 3, c - rng.random() * 3, c, 1 + rng.random() * 3, rng.randint(0, 2)))
    df = spark.createDataFrame([("S", *b) for b in bars], "symbol string, idx int, high double, low double, close double, atr double, action int")
    got = sorted((r.idx, r.equity, r.cash, r.held, r.reward) for r in simulate.episode(df).collect())
    want = _walk(bars)
    assert len(got) == len(want) and all(g[3] == w[3] and g[1] == pytest.approx(w[1]) and g[2] == pytest.approx(w[2]) and g[4] == pytest.approx(w[4], abs=1e-12) for g, w in zip(got, want, strict=True))


def test_vector_search_equals_brute_force(spark):
    import numpy as np

    from candlewick.operators import vectors

    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.integers(-2, 3, 6)], f"l{i % 3}") for i in range(300)] + [(900, None, "n"), (901, [0.0] * 6, "z")]
    store = spark.createDataFrame(rows, "record_id long, embedding array<double>, label string").repartition(7)
    asked = [r for r in rows if r[0] % 50 == 0 and r[1]]
    queries = spark.createDataFrame([(i, v) for i, v, _ in asked], "query_id long, query array<double>")
    want = []
    for q, v, _ in asked:
        if not any(v):
            continue
        near = sorted(((-float(np.dot(v, x)) / (np.linalg.norm(v) * np.linalg.norm(x) + 1e-12), i) for i, x, _ in rows if x is not None))[:9]
        want += [(q, i, k + 1) for k, (_, i) in enumerate(near)]
    for few in (4096, 2):
        got = vectors.search(queries, store, 9, few=few).select("query_id", "record_id", "rank").collect()
        sims = {(r.query_id, r["rank"]): r.record_id for r in got}
        assert len(sims) == len(got) == len(want)
        exact = {(q, k): i for q, i, k in want}
        # equal similarities may differ in the last bit between ways of adding up
        assert sum(sims[x] != exact[x] for x in exact) <= 0.1 * len(exact)
    with pytest.raises(Exception, match="haven't 6 numbers"):
        vectors.search(queries, spark.createDataFrame([(1, [1.0])], "record_id long, embedding array<double>"), 3).collect()


def test_steps_and_cosine(spark):
    assert [scalars.horizon_steps(h, e) for h, e in (("1h", "5m"), ("15m", "1h"), ("90m", "1h"), ("1w", "1d"))] == [12, 1, 2, 7]
    df = spark.createDataFrame([([3.0, 4.0], [4.0, 3.0]), ([0.0, 0.0], [1.0, 1.0])], "a array<double>, b array<double>")
    assert [round(r[0], 6) for r in df.select(F.expr(scalars.cosine("a", "b"))).collect()] == [0.96, 0.0]
