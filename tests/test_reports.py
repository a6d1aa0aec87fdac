import csv
import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from candlewick import __main__ as cli
from candlewick.operators import backtest
from candlewick.plans import queries
from candlewick.sources import candles, reports

DIR = "/root/testdata/sf0.001"


def test_reports_round_trip(spark, tmp_path):
    taken, starts = queries._taken(spark, DIR)
    curve = backtest.equity_curve(taken, starts, queries.CFG)
    reports.write(taken, curve, queries.CFG, str(tmp_path))
    (tmp_path / "metrics/policy=broken").mkdir()
    (tmp_path / "metrics/policy=broken/part-0.json").write_text("{not json")
    got = reports.read_metrics(spark, str(tmp_path))
    want = backtest.metrics(taken, curve, queries.CFG)
    assert sorted((r.policy, r.trade_count) for r in got.collect() if r.trade_count is not None) == sorted((r.policy, r.trade_count) for r in want.collect())
    assert {"equity_curve", "drawdown_curve", "trades", "metrics"} <= {p.name for p in tmp_path.iterdir()}


def test_literals_and_settings(spark, tmp_path):
    df = spark.createDataFrame([("{'a': 1.5, 'b': None}",)], "t string").select(reports.literal("t", "map<string,double>").alias("m"))
    assert df.first().m == {"a": 1.5, "b": None}
    reports.patterns_as_csv(df, str(tmp_path / "p"))
    lines = [x for p in (tmp_path / "p").glob("*.csv") for x in p.read_text().splitlines() if "{" in x]
    assert [json.loads(x.strip('"').replace('\\"', '"'))["a"] for x in lines] == [1.5]
    assert reports.symbols([" B/U ", "A/U", "B/U"]) == ["A/U", "B/U"]
    with pytest.raises(ValueError):
        reports.symbols(["BTC"])
    assert reports.trigger_timeframes(["5m", "1d", "4h"]) == ["1d", "4h"] and reports.trigger_timeframes(["5m"]) == ["5m"]


def test_pattern_records_of_printed_values(spark, tmp_path):
    """Columns as Python prints them, with apostrophes, tuples, nan and line breaks."""
    rows = [
        ("A/U", 5, "O'Neil \"cup\"", {"it's": 1.5, 'q"': 2}, {"regime": "low", "atr": 1.0, "atr_percent": 0.5}, [1, 2.5], {"1h": -0.25}),
        ("B/U", 6, "two\nlines", {}, {"regime": None, "atr": float("nan"), "atr_percent": -1e-9}, (0.5, float("nan"), -float("inf")), {}),
    ]
    with (tmp_path / "p.csv").open("w", newline="") as f:
        out = csv.writer(f)
        out.writerow(["symbol", "timestamp", "pattern_type", "detector_features", "volatility_context", "embedding", "forward_returns"])
        out.writerows([*r[:3], *map(repr, r[3:])] for r in rows)
        out.writerow(["C/U", 7, "x", "{'a': ", "", "[1", "__import__('os')"])
    got = sorted(reports.patterns_from_csv(spark, str(tmp_path / "p.csv")).collect())
    assert [(r.symbol, r.timestamp, r.pattern_type) for r in got] == [r[:3] for r in rows] + [("C/U", 7, "x")]
    assert got[0].detector_features == {"it's": 1.5, 'q"': 2.0} and got[0].embedding == [1.0, 2.5] and got[0].forward_returns == {"1h": -0.25}
    assert (got[1].volatility_context.atr, got[1].volatility_context.atr_percent, got[1].volatility_context.regime) == (None, -1e-9, None)
    assert got[1].embedding == [0.5, None, None] and got[1].detector_features == {} == got[1].forward_returns
    assert got[2].detector_features is None and got[2].embedding is None and got[2].forward_returns is None


def test_command_line(spark, tmp_path, capsys):
    both = candles.from_events(spark, DIR, "4h").unionByName(candles.from_events(spark, DIR, "1h"))
    both.withColumn("symbol", F.concat("symbol", F.lit("/U"))).write.parquet(str(tmp_path / "c"))
    cli.main(["build-pattern-db", "--candles", str(tmp_path / "c"), "--out", str(tmp_path / "p"), "--timeframes", "4h"])
    assert spark.read.parquet(str(tmp_path / "p")).count() > 100
    queries._signals(spark, DIR).withColumn("symbol", F.concat("symbol", F.lit("/U"))).write.parquet(str(tmp_path / "s"))
    cli.main(["backtest", "--signals", str(tmp_path / "s"), "--candles", str(tmp_path / "c"), "--timeframe", "1h", "--out", str(tmp_path / "r")])
    cli.main(["backtest-rank", "--reports", str(tmp_path / "r")])
    assert "p-click" in capsys.readouterr().out


def test_continual_learning(spark, tmp_path, capsys, monkeypatch):
    """Download, update, rebuild, train, compare and promote, from a service of random walks."""
    here = Path(__file__).parent
    spark.sparkContext.addPyFile(str(here / "paged_service.py"))
    monkeypatch.syspath_prepend(str(here))
    c, out = str(tmp_path / "c"), str(tmp_path / "m")
    service = ["--fetch", "paged_service:walk", "--exchanges", "x", "--symbols", "A/U", "--timeframes", "4h,1h", "--candles", c]
    cli.main(["download-data", *service])
    n = spark.read.parquet(c).count()
    assert n == 1500 and sorted(r.timeframe for r in spark.read.parquet(c).select("timeframe").distinct().collect()) == ["1h", "4h"]
    cli.main(["update-data", *service])
    assert spark.read.parquet(c).count() == n
    cli.main(["continual-learning", *service, "--patterns", str(tmp_path / "p"), "--models", out, "--detection", "4h", "--poll", "0", "--max-cycles", "2"])
    assert capsys.readouterr().out.strip().endswith("2")
    first = json.loads(spark.read.text(f"{out}/A_U/cycles/0/promotion").first()[0])
    assert first["promote"] == {"model": True, "sequence": True} and "champion model" not in first and first["candidate sequence"]["trade_count"] >= 0
    assert (tmp_path / "m/A_U/champion/model/meta").exists() and (tmp_path / "m/A_U/champion/sequence/meta").exists() and not (tmp_path / "m/A_U/cycles/1").exists()
    cli.main(["continual-learning", *service, "--patterns", str(tmp_path / "p"), "--models", out, "--detection", "4h", "--poll", "0", "--max-cycles", "1"])
    assert (tmp_path / "m/A_U/cycles/0/promotion").stat().st_mtime_ns == min(p.stat().st_mtime_ns for p in (tmp_path / "m/A_U/cycles").glob("*/promotion"))
    cli.main(["train-sequence", "--records", str(tmp_path / "p"), "--out", str(tmp_path / "s"), "--length", "3"])
    cli.main(["compare", "--records", str(tmp_path / "p"), "--candles", c, "--out", str(tmp_path / "r"), "--model", out + "/A_U/champion/model", "--sequence", str(tmp_path / "s"), "--timeframe", "1h", "--max-events", "20"])
    assert "pattern-similarity" in capsys.readouterr().out
