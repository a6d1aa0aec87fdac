"""What runs along a series gives the same in slices of any length as in one piece."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from candlewick.operators import backtest, indicators, labeling, slices
from candlewick.sources import candles


def plain(v):
    return round(v, 9) if isinstance(v, float) else v


def listed(df, columns):
    return sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=str)


@pytest.fixture(scope="module")
def bars(spark):
    rng, rows = np.random.default_rng(1), []
    for symbol, n in (("A", 400), ("B", 9), ("C", 15), ("D", 1)):
        for t in np.sort(rng.choice(5000, n, replace=False)).tolist():
            o, c, x, y = (float(v) for v in rng.random(4))
            rows.append(("e", symbol, "1h", t, o, max(o, c) + x, min(o, c) - y, c, 1.0))
    return spark.createDataFrame(rows, candles.SCHEMA).repartition(5).cache()


@pytest.mark.parametrize("length", [3, 40])
def test_true_ranges(bars, length):
    columns = ["symbol", "timestamp", "idx", "n", "tr", "atr", "close"]
    want = listed(indicators.with_atr(bars), columns)
    assert listed(indicators.with_atr(bars, short=50, rows=length), columns) == want
    assert listed(indicators.with_atr(bars, short=500), columns) == want


@pytest.mark.parametrize("length", [2, 33])
def test_as_of(spark, bars, length):
    rng = np.random.default_rng(2)
    events = spark.createDataFrame([(i, "ABCDX"[i % 5], int(rng.integers(-10, 5100))) for i in range(300)], "i int, symbol string, timestamp long")
    columns = ["i", "symbol", "timestamp", "close", "low"]
    want = listed(labeling.next_at_or_after(events, bars, ["symbol"], ["close", "low"]), columns)
    assert listed(labeling.next_at_or_after(events, bars, ["symbol"], ["close", "low"], short=50, length=length), columns) == want
    assert any(w[3] is None for w in want) and any(w[3] is not None for w in want)


def test_drawdowns(bars):
    columns = ["symbol", "timestamp", "close", "drawdown"]
    curve = bars.select("symbol", "timestamp", "close")
    got = indicators.drawdowns(curve, "symbol", "timestamp", "close", short=50, length=7)
    assert got.columns == columns and listed(got, columns) == listed(indicators.drawdowns(curve, "symbol", "timestamp", "close"), columns)


def test_slices_are_bounded_and_in_order(bars):
    df = slices.sliced(bars.unionByName(bars), ["symbol"], ["timestamp"], 30)
    each = df.groupBy("symbol", "__slice").agg(F.count("*").alias("n"), F.min("timestamp").alias("a"), F.max("timestamp").alias("b")).orderBy("symbol", "__slice").collect()
    assert max(r.n for r in each) <= 30 and len(each) > 25
    assert all(x.b <= y.a for x, y in zip(each, each[1:], strict=False) if x.symbol == y.symbol)


@pytest.mark.parametrize("widths", [(86_400_000, 60_000, 1), (50, 7, 1), (1,)])
def test_order_statistics(spark, widths):
    rng = np.random.default_rng(3)
    values = {"a": rng.integers(-(10**11), 10**11, 500), "b": rng.integers(0, 60, 300), "c": np.array([7])}
    values["a"] = values["a"] // (1 if widths[0] > 50 else 10**9)
    df = spark.createDataFrame([(k, int(v)) for k, x in values.items() for v in x], "policy string, timestamp long").repartition(4)
    wanted = [(k, int(i)) for k, x in values.items() for i in {0, len(x) // 2, len(x) - 1}]
    got = slices.order_statistics(df, ["policy"], "timestamp", spark.createDataFrame(wanted, "policy string, k long"), widths)
    assert sorted(map(tuple, got.select("policy", "k", "value").collect())) == sorted((k, i, int(np.sort(values[k])[i])) for k, i in wanted)


@pytest.mark.parametrize("fraction", [0.0, 0.37, 0.95, 1.0])
def test_evaluation_start(spark, fraction):
    rng = np.random.default_rng(4)
    values = {"a": 1_700_000_000_000 + rng.integers(0, 10**10, 401), "b": 1_700_000_000_000 + rng.integers(0, 3, 50), "c": np.array([5])}
    df = spark.createDataFrame([(k, int(v)) for k, x in values.items() for v in x] + [("a", None)], "policy string, timestamp long")
    got = {r.policy: r.eval_start for r in backtest.evaluation_start(df, fraction).collect()}
    assert got == {k: int(np.quantile(x, fraction)) for k, x in values.items()}


def fold(rows, starts, cfg):
    """The portfolio by a plain loop: (policy, number, timestamp, exit_ts, equity_before, equity)."""
    out = []
    for policy in sorted(starts):
        last, equity, number = -1, cfg.initial_equity, 0
        for r in sorted(r for r in rows if r[0] == policy and r[1] >= starts[policy]):
            if r[1] >= last and equity > 0 and (cfg.max_trades is None or number < cfg.max_trades):
                out.append((policy, number, r[1], r[5], equity, equity * (1 + r[6])))
                last, equity, number = r[5], equity * (1 + r[6]), number + 1
    return out


@pytest.mark.parametrize("length", [1, 4, 50, 100_000])
@pytest.mark.parametrize(("span", "holding", "cap", "ruin"), [(3000, 40, None, False), (60, 3, None, False), (500, 400, 7, False), (800, 25, None, True)])
def test_portfolio(spark, length, span, holding, cap, ruin):
    rng, rows = np.random.default_rng(span), []
    for policy, n in (("p", 250), ("q", 40), ("r", 1), ("s", 30)):
        for i in range(n):
            t = int(rng.integers(0, span))
            share = -1.5 if ruin and rng.random() < 0.03 else float(rng.normal(0, 0.02))
            rows.append((policy, t, f"k{i % 5}", "S", int(rng.choice([-1, 1])), t + int(rng.integers(0, holding)), share, 0.9, "horizon", 1.0, 2.0, 3.0))
    starts = {"p": 10, "q": 0, "r": 0, "s": span + 1}
    cfg = backtest.BacktestConfig(max_trades=cap)
    df = spark.createDataFrame(rows, "policy string, timestamp long, pattern_type string, symbol string, direction int, exit_ts long, share double, confidence double, exit_reason string, qty double, entry_price double, exit_price double")
    got = backtest.portfolio(df.repartition(5), spark.createDataFrame(list(starts.items()), "policy string, eval_start long"), cfg, length)
    columns = ["policy", "number", "timestamp", "exit_ts", "equity_before", "equity"]
    assert [tuple(round(v, 5) if isinstance(v, float) else v for v in g) for g in sorted(tuple(r[c] for c in columns) for r in got.collect())] == [tuple(round(v, 5) if isinstance(v, float) else v for v in w) for w in sorted(fold(rows, starts, cfg))]
