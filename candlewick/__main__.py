"""python -m candlewick COMMAND: a thin command line over the library."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from candlewick.functions.scalars import horizon_steps
from candlewick.operators import backtest, records, training
from candlewick.session import local_session
from candlewick.sources import candles, paged, reports
from candlewick.streaming import live


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="candlewick")
    sub = p.add_subparsers(dest="command", required=True)

    def command(name: str, text: str, **options: object) -> argparse.ArgumentParser:
        """Options without a default are required."""
        made = sub.add_parser(name, help=text)
        for o, default in options.items():
            kind = type(default) if isinstance(default, (int, float, str)) and default is not ... else str
            made.add_argument("--" + o.replace("_", "-"), type=kind, required=default is ..., default=None if default is ... else default)
        return made

    service = {"fetch": ..., "exchanges": ..., "symbols": ..., "timeframes": "1d,4h,1h,15m,5m", "candles": ...}
    command("download-data", "download all candles of a service's series", **service, since=0)
    command("update-data", "download what is newer than the stored candles", **service)
    command("build-pattern-db", "detect, label, embed and store patterns of stored candles", candles=..., out=..., timeframes="1d,4h", labels="1h", exchanges="", symbols="")
    command("train", "train direction and return models on pattern records", records=..., out=..., horizon="1h", max_rows=50_000)
    command("train-sequence", "the same on windows of records", records=..., out=..., horizon="1h", max_rows=25_000, length=12, stride=1, max_windows=0)
    execution = {"candles": ..., "out": ..., "timeframe": "5m", "eval_fraction": 0.7}
    command("backtest", "backtest stored signals and write reports", signals=..., **execution | {"eval_fraction": 0.95})
    command("compare", "backtest the policies of trained models over the same events", records=..., model="", sequence="", **execution, symbol="", decision="4h", horizon="1h", max_events=500, top_k=50)
    command("backtest-rank", "rank the policies of a report folder", reports=...)
    command("continual-learning", "update, rebuild, train, compare and promote, again and again", **service, patterns=..., models=..., labels="1h", detection="1d,4h", poll=300.0, max_cycles=0)
    return p


def _downloaded(spark: SparkSession, a: argparse.Namespace, newest: DataFrame | None) -> DataFrame:
    since = {} if newest is None else {f"{r.symbol}|{r.timeframe}": r.latest for r in newest.groupBy("symbol", "timeframe").agg(F.max("latest").alias("latest")).collect()}
    spark.dataSource.register(paged.PagedCandles)
    options = {"fetch": a.fetch, "exchanges": a.exchanges, "symbols": ",".join(reports.symbols(a.symbols.split(","))), "timeframes": a.timeframes}
    return spark.read.format("paged_candles").options(**options, since=str(getattr(a, "since", 0)), since_by=json.dumps(since)).load()


def _update(spark: SparkSession, a: argparse.Namespace) -> int | None:
    """Stores what is newer, and gives the newest time stored."""
    stored = candles.stored(spark, a.candles)
    candles.merge(spark, a.candles, _downloaded(spark, a, candles.latest(stored) if stored is not None else None))
    return candles.stored(spark, a.candles).agg(F.max("timestamp")).first()[0]


def _symbols(rows: DataFrame, wanted: str) -> list[str]:
    """The symbols to go through one by one: those wanted, else all that rows have."""
    return [wanted] if wanted else sorted(r.symbol for r in rows.select("symbol").distinct().collect())


def _compare(spark: SparkSession, a: argparse.Namespace) -> None:
    """A portfolio, a ranking and a report folder for each symbol."""
    every = spark.read.parquet(a.records).where(F.col("timeframe") == a.decision)
    cfg = backtest.BacktestConfig(eval_fraction=a.eval_fraction, horizon_steps=horizon_steps(a.horizon, a.timeframe))
    store = every.withColumn("record_id", F.xxhash64("symbol", "timeframe", "timestamp", "pattern_type"))
    policies = {"pattern-similarity": training.similarity_policy(store, a.top_k, cfg)}
    if a.model:
        policies["model"] = training.model_policy(training.load(spark, a.model), cfg)
    if a.sequence:
        policies["sequence"] = training.sequence_policy(training.load(spark, a.sequence), cfg)
    execution = spark.read.parquet(a.candles).where(F.col("timeframe") == a.timeframe)
    names = _symbols(every, a.symbol)
    for name in names:
        ranked, taken, curve = training.compare(every.where(F.col("symbol") == name), execution.where(F.col("symbol") == name), policies, cfg, a.max_events)
        reports.write(taken, curve, cfg, a.out if len(names) == 1 else f"{a.out}/{name.replace('/', '_')}")
        ranked.select(F.lit(name).alias("symbol"), "place", "policy", *backtest.METRICS).orderBy("place").show(100, False)


def _continual(spark: SparkSession, a: argparse.Namespace) -> int:
    """A cycle does nothing unless the stored candles got newer since the last one, of this run or an earlier one. Each symbol has models and
    decisions of its own; one without enough rows is passed over."""
    noted, exchanges = f"{a.models}/newest", a.exchanges.split(",")

    def cycle(number: int) -> None:
        newest = _update(spark, a)
        if newest is None or newest <= live.newest_seen(spark, noted):
            return
        wanted = reports.trigger_timeframes(a.timeframes.split(","), a.detection.split(",") if a.detection else None)
        stored = candles.stored(spark, a.candles)
        records.build(stored, wanted, a.labels, exchanges=exchanges).write.mode("overwrite").parquet(a.patterns)
        rows = spark.read.parquet(a.patterns)
        for name in reports.symbols(a.symbols.split(",")):
            mine, folder = rows.where(F.col("symbol") == name), f"{a.models}/{name.replace('/', '_')}"
            try:
                training.train_kinds(mine, folder)
            except ValueError as e:
                print(f"{name} is passed over: {e}")
                continue
            execution = candles.of_one_exchange(stored.where(F.col("symbol") == name), [a.labels], exchanges).where(F.col("timeframe") == a.labels)
            training.promote(spark, mine.where(F.col("timeframe") == wanted[-1]), execution, folder, number)
        live.note_newest(spark, noted, newest)

    return live.poll(cycle, a.max_cycles or None, a.poll, lambda n, e: print(f"cycle {n} failed: {e}"))


def main(argv: list[str] | None = None) -> None:
    a = _parser().parse_args(argv)
    spark = local_session()
    if a.command == "download-data":
        candles.merge(spark, a.candles, _downloaded(spark, a, None))
    elif a.command == "update-data":
        print(_update(spark, a))
    elif a.command == "build-pattern-db":
        stored = spark.read.parquet(a.candles).select(*candles.COLUMNS)
        stored = stored.where(F.col("symbol").isin(reports.symbols(a.symbols.split(",")))) if a.symbols else stored
        records.build(stored, a.timeframes.split(","), a.labels, exchanges=a.exchanges.split(",") if a.exchanges else None).write.mode("overwrite").parquet(a.out)
    elif a.command in ("train", "train-sequence"):
        print(json.dumps(training.train(spark.read.parquet(a.records), a.out, a.horizon, a.max_rows, *((a.length, a.stride, a.max_windows or None) if a.command != "train" else ()))))
    elif a.command == "backtest":
        signals, cfg = spark.read.parquet(a.signals), backtest.BacktestConfig(eval_fraction=a.eval_fraction)
        starts = backtest.evaluation_start(signals, cfg.eval_fraction)
        taken = backtest.portfolio(backtest.trades(signals, spark.read.parquet(a.candles).where(F.col("timeframe") == a.timeframe), cfg), starts, cfg)
        reports.write(taken, backtest.equity_curve(taken, starts, cfg), cfg, a.out)
    elif a.command == "compare":
        _compare(spark, a)
    elif a.command == "continual-learning":
        print(_continual(spark, a))
    else:
        backtest.ranked(reports.read_metrics(spark, a.reports)).select("place", "policy", *backtest.METRICS).orderBy("place").show(100, False)


if __name__ == "__main__":
    main()
