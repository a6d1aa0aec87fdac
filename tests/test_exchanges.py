"""Results don't mix exchanges or symbols: what is built, labelled and traded for one is the same whichever others are there."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from candlewick.operators import backtest, labeling, records, training
from candlewick.sources import candles

HOUR = 3_600_000


def walk(exchange, symbol, seed, n=900, start=100.0, frames=(("1h", 1), ("4h", 4))):
    rng = np.random.default_rng(seed)
    close = start * np.exp(np.cumsum(rng.normal(0, 0.01, n)))
    rows = []
    for name, k in frames:
        for i in range(0, n - k + 1, k):
            part = close[max(i - 1, 0) : i + k]
            rows.append((exchange, symbol, name, i * HOUR, float(part[0]), float(part.max() * 1.001), float(part.min() * 0.999), float(part[-1]), float(50 + rng.random() * 100)))
    return rows


@pytest.fixture(scope="module")
def market(spark):
    """A/U on two exchanges with other prices; B/U whole on the second one only."""
    rows = walk("x", "A/U", 1) + walk("y", "A/U", 2, start=7.0) + walk("x", "B/U", 3, frames=(("4h", 4),)) + walk("y", "B/U", 4)
    return spark.createDataFrame(rows, candles.SCHEMA).cache()


def listed(df):
    return sorted(str(r.asDict(recursive=True)) for r in df.collect())


def test_each_symbol_is_built_as_if_alone(spark, market):
    both = records.build(market, ["4h", "1h"], exchanges=["x", "y"])
    alone = [records.build(market.where((F.col("exchange") == e) & (F.col("symbol") == s)), ["4h", "1h"]) for e, s in (("x", "A/U"), ("y", "B/U"))]
    want = sorted(listed(alone[0]) + listed(alone[1]))
    assert listed(both) == want and len(want) > 200
    assert {r.label for r in both.select("label").distinct().collect()} == {"Good", "Bad", "Neutral"}


def test_returns_stay_within_an_exchange(spark):
    rows = [(e, "S", "1h", i * HOUR, 1.0, 1.0, 1.0, float(base * (1 + i / 100)), 1.0) for e, base in (("x", 1), ("y", 1000)) for i in range(40)]
    df = labeling.forward_returns(spark.createDataFrame(rows, candles.SCHEMA)).where("timestamp = 0").collect()
    assert {r.exchange: round(r.fwd_1h, 9) for r in df} == {"x": 0.01, "y": 0.01}


def test_trades_stay_within_an_exchange(spark, market):
    bars = market.where("timeframe = '1h' AND symbol = 'A/U'")
    signals = bars.where(F.col("timestamp") % (50 * HOUR) == 0).select("exchange", "symbol", "timestamp", F.lit("p").alias("policy"), F.lit(1).alias("direction"), F.lit(0.9).alias("confidence"))
    both = backtest.trades(signals, bars)
    want = sorted(str(r.asDict()) for e in ("x", "y") for r in backtest.trades(signals.where(F.col("exchange") == e), bars.where(F.col("exchange") == e)).collect())
    assert listed(both) == want and len(want) > 10


def test_neighbours_of_other_symbols_have_no_say(spark):
    """The event's own symbol has Good neighbours only; Bad ones of another symbol and timeframe are nearer."""
    own = [(i, "A", "4h", i, "Good", [1.0, 0.3 + i / 100]) for i in range(5)]
    others = [(100 + i, "B", "4h", i, "Bad", [1.0, 0.0]) for i in range(50)] + [(200 + i, "A", "1h", i, "Bad", [1.0, 0.0]) for i in range(50)]
    store = spark.createDataFrame(own + others, "record_id long, symbol string, timeframe string, timestamp long, label string, embedding array<double>")
    events = spark.createDataFrame([(1, "A", "4h", 99, "Doji", [1.0, 0.0]), (2, "C", "4h", 99, "Doji", [1.0, 0.0]), (3, "A", "4h", 3, "Doji", [1.0, 0.0])], "event_id long, symbol string, timeframe string, timestamp long, pattern_type string, embedding array<double>")
    got = {r.event_id: r for r in training.similarity_policy(store, 10)(events).collect()}
    assert got[1].p_long > 0.999 and got[1].direction == 1
    assert (got[2].p_long, got[2].direction, got[2].confidence) == (0.5, 0, 0.0)
    assert got[3].direction == 1


def skewed(spark, n=600):
    rng = np.random.default_rng(5)
    rows = []
    for i in range(n):
        good = i % 10 == 0
        x = rng.normal(size=64) + (0.4 if good else 0)
        rows.append(("A", "4h", i * HOUR, f"p{i % 2}", "Good" if good else "Bad", {"1h": float(rng.normal())}, [float(v) for v in x]))
    return spark.createDataFrame(rows, "symbol string, timeframe string, timestamp long, pattern_type string, label string, forward_returns map<string,double>, embedding array<double>")


def newton(x, y, weight):
    """Logistic regression with an unpenalised intercept and C = 1, by Newton steps."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w, penalty = np.zeros(x.shape[1]), np.append(np.ones(x.shape[1] - 1), 0)
    for _ in range(60):
        p = 1 / (1 + np.exp(-x @ w))
        w -= np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + np.diag(penalty), x.T @ (weight * (p - y)) + penalty * w)
    return w


@pytest.mark.parametrize("length", [1, 3])
def test_classes_weigh_the_same_for_sequences_alone(spark, tmp_path, length):
    df = skewed(spark)
    training.train(df, str(tmp_path / "m"), length=length)
    model = training.load(spark, str(tmp_path / "m"))
    rows = sorted(df.collect(), key=lambda r: (r.timestamp, r.pattern_type))
    x = np.array([np.concatenate([r.embedding for r in rows[i - length + 1 : i + 1]]) for i in range(length - 1, len(rows))])
    y, ts = np.array([float(r.label == "Good") for r in rows[length - 1 :]]), np.array([r.timestamp for r in rows[length - 1 :]])
    start = ts[int(len(ts) * 0.8)]
    fit = ts <= start - 24 * HOUR
    scaled = (x - x[fit].mean(0)) / x[fit].std(0)
    share = y[fit].mean()
    weight = np.where(y[fit] == 1, 0.5 / share, 0.5 / (1 - share)) if length > 1 else np.ones(fit.sum())
    w = newton(scaled[fit], y[fit], weight)
    want = 1 / (1 + np.exp(-(scaled @ w[:-1] + w[-1])))
    asked = spark.createDataFrame([(i, [float(v) for v in x[i]]) for i in range(0, len(x), 20)], "i int, embedding array<double>")
    got = {r.i: r.p for r in model.scored(asked).collect()}
    assert max(abs(got[i] - want[i]) for i in got) < 1e-4


def test_the_newest_windows_are_kept(spark, tmp_path):
    df = skewed(spark)
    training.train(df, str(tmp_path / "m"), length=4, max_windows=100)
    assert training.load(spark, str(tmp_path / "m")).meta["num_samples"] <= 100


def test_events_that_policies_see(spark):
    """The plain policy gets the first events; the one with context also earlier and all later ones, and is limited by its trades."""
    n, seen = 400, {}
    df = spark.createDataFrame([("A", "4h", i * 4 * HOUR, "p", [1.0] * 64) for i in range(n)], "symbol string, timeframe string, timestamp long, pattern_type string, embedding array<double>")
    bars = spark.createDataFrame(walk("x", "A", 9, 4 * n + 60, frames=(("1h", 1),)), candles.SCHEMA)

    def policy(name):
        def run(events):
            seen[name] = sorted(r.timestamp // (4 * HOUR) for r in events.collect())
            return events.select("event_id", F.lit(0.9).alias("p_long"), F.lit(1).alias("direction"), F.lit(0.9).alias("confidence"))

        return run

    plain, sequence = policy("plain"), policy("sequence")
    sequence.context = 3
    found, taken, _ = training.compare(df, bars, {"plain": plain, "sequence": sequence}, backtest.BacktestConfig(eval_fraction=0.5), 20)
    first = int(np.quantile(np.arange(n) * 4 * HOUR, 0.5)) // (4 * HOUR) + 1
    assert seen["plain"] == list(range(first, first + 20)) and seen["sequence"] == list(range(first - 3, n))
    trades = {r.policy: (r.n, r.last // (4 * HOUR)) for r in taken.groupBy("policy").agg(F.count("*").alias("n"), F.max("timestamp").alias("last")).collect()}
    assert trades["plain"][0] <= 20 and trades["sequence"][0] == 20 and trades["sequence"][1] >= trades["plain"][1]
