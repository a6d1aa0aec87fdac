"""Training end to end: labelled rows, a split in time with an embargo, models, scores, artefacts, and their use as policies."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from candlewick.operators import backtest, datasets, models, vectors
from candlewick.session import written
from candlewick.sources.candles import of_one_exchange

LEAST_ROWS, LEAST_SIDE = 10, 5


def rows_of(records: DataFrame, horizon: str = "1h", cap: int | None = 50_000, all_or_none: bool = True) -> DataFrame:
    """Good and Bad records (the newest cap / 2 of each, if there are more) as symbol, timeframe, timestamp, pattern_type, embedding, y_dir, y_return.

    Where some rows lack the horizon's return, there is no return target (all_or_none), or such rows are dropped if any has one (as sequences
    want it). Returns that aren't finite are dropped.
    """
    known = records.where(F.col("label").isin("Good", "Bad"))
    known = datasets.recent_balanced(known, cap) if cap is not None else known
    y = F.col("forward_returns")[horizon].cast("double")
    rows = known.select("symbol", "timeframe", "timestamp", "pattern_type", "embedding", datasets.label_number(F.col("label")).alias("y_dir"), y.alias("y_return"))
    n, lacking, wrong = rows.agg(F.count(F.lit(1)), F.count_if(F.col("y_return").isNull()), F.count_if(F.size("embedding") != 64)).first()
    if not n:
        raise ValueError("too few rows: no Good or Bad ones")
    if wrong:
        raise ValueError(f"{wrong} embeddings haven't 64 numbers")
    if lacking == n or (lacking and all_or_none):
        return rows.withColumn("y_return", F.lit(None).cast("double"))
    return rows.where("y_return IS NOT NULL AND NOT isnan(y_return) AND abs(y_return) < double('Infinity')")


@dataclass
class Trained:
    """direction and returns (None without a target) work on the vector `embedding`, for sequences on the windows' numbers one after the other."""

    direction: PipelineModel
    returns: PipelineModel | None
    scaler: DataFrame
    meta: dict[str, object]

    def scored(self, rows: DataFrame) -> DataFrame:
        """rows (embedding) with p, and expected where there is a return model."""
        df = models.probability(self.direction, models.with_scaler(rows, "embedding", self.scaler))
        if self.returns is not None:
            df = self.returns.transform(df).withColumnRenamed("prediction", "expected")
        return df.drop("features")


def train(records: DataFrame, path: str, horizon: str = "1h", cap: int | None = None, length: int = 1, stride: int = 1, max_windows: int | None = None) -> dict[str, object]:
    """Fits both models on the older rows, scores them on the newest fifth, and writes them below `path`; the scores.

    length > 1: on windows of so many records of a series, whose last one gives the target (at most 25,000 rows; else 50,000), the newest
    `max_windows` of them if that is given. Classes weigh the same there; otherwise each row does.
    """
    sequence = length > 1
    rows = rows_of(records, horizon, cap if cap is not None else (25_000 if sequence else 50_000), all_or_none=not sequence)
    if sequence:
        windows = datasets.sequences(rows, length, stride)
        windows = windows if max_windows is None else datasets.recent_windows(windows, max_windows)
        rows = windows.withColumn("embedding", F.flatten("window")).withColumnRenamed("ts_end", "timestamp").drop("window")
    split = written(datasets.time_split(rows), "training-split")
    sides = {r.split: r.n for r in split.groupBy("split").agg(F.count(F.lit(1)).alias("n")).collect()}
    if sum(sides.values()) < LEAST_ROWS or min(sides.get("train", 0), sides.get("val", 0)) < LEAST_SIDE:
        raise ValueError(f"too few rows for a split in time: {sides}")
    fit, val = split.where("split = 'train'"), split.where("split = 'val'")
    scaler = written(models.scaler(fit, "embedding"), "training-scaler")
    features = models.with_scaler(fit, "embedding", scaler)
    target = fit.where("y_return IS NOT NULL").limit(1).count() > 0
    trained = Trained(models.direction_model(features, balanced=sequence), models.return_model(features) if target else None, scaler, {})
    scored = written(trained.scored(val), "training-scores")
    by = datasets.classification_scores(scored.select(F.col("y_dir").alias("y"), "p")).first()
    scores: dict[str, object] = {"val_accuracy": by["accuracy"]} | ({"val_roc_auc": by["auc"]} if by["auc"] is not None else {})
    if target:
        scores["val_return_mae"] = datasets.regression_scores(scored.select(F.col("y_return").alias("y"), F.col("expected").alias("p"))).first()["mae"]
    trained.meta = {"horizon": horizon, "length": length, "stride": stride, "metrics": scores, "num_samples": sum(sides.values()), "sides": sides, "returns": target}
    save(trained, path)
    return scores


def save(trained: Trained, path: str) -> None:
    spark = trained.scaler.sparkSession
    models.saved(trained.direction, f"{path}/direction")
    if trained.returns is not None:
        models.saved(trained.returns, f"{path}/returns")
    trained.scaler.write.mode("overwrite").parquet(f"{path}/scaler")
    text = F.lit(json.dumps(trained.meta))
    spark.range(1).select(text.alias("value")).coalesce(1).write.mode("overwrite").text(f"{path}/meta")


def load(spark: SparkSession, path: str) -> Trained:
    meta = json.loads(spark.read.text(f"{path}/meta").first()[0])
    returns = PipelineModel.load(f"{path}/returns") if meta["returns"] else None
    return Trained(PipelineModel.load(f"{path}/direction"), returns, spark.read.parquet(f"{path}/scaler"), meta)


#: A policy takes events (event_id, symbol, timeframe, timestamp, pattern_type, embedding) and gives event_id, p_long, direction, confidence.
Policy = Callable[[DataFrame], DataFrame]


def model_policy(trained: Trained, cfg: backtest.BacktestConfig = backtest.BacktestConfig()) -> Policy:
    def run(events: DataFrame) -> DataFrame:
        p = trained.scored(events.select("event_id", "embedding")).select("event_id", F.col("p").alias("p_long"))
        return p.select("event_id", "p_long", backtest.direction(F.col("p_long"), cfg).alias("direction"), F.greatest("p_long", 1 - F.col("p_long")).alias("confidence"))

    return run


def sequence_policy(trained: Trained, cfg: backtest.BacktestConfig = backtest.BacktestConfig()) -> Policy:
    """An event's probability is that of the last window that ends at its time, a half without any; without a direction its confidence is 0."""

    def run(events: DataFrame) -> DataFrame:
        windows = datasets.sequences(events.select("event_id", "symbol", "timeframe", "timestamp", "pattern_type", "embedding"), int(trained.meta["length"]), int(trained.meta["stride"]))
        windows = windows.select("symbol", "timeframe", "ts_end", "pattern_type", F.flatten("window").alias("embedding"))
        p = trained.scored(windows).groupBy("symbol", "timeframe", F.col("ts_end").alias("timestamp")).agg(F.max_by("p", "pattern_type").alias("p"))
        df = events.select("event_id", "symbol", "timeframe", "timestamp").join(p, ["symbol", "timeframe", "timestamp"], "left").withColumn("p_long", F.coalesce("p", F.lit(0.5)))
        df = df.withColumn("direction", backtest.direction(F.col("p_long"), cfg))
        return df.select("event_id", "p_long", "direction", F.when(F.col("direction") != 0, F.greatest("p_long", 1 - F.col("p_long"))).otherwise(0.0).alias("confidence"))

    run.context = int(trained.meta["length"]) - 1
    return run


def similarity_policy(store: DataFrame, k: int = 50, cfg: backtest.BacktestConfig = backtest.BacktestConfig()) -> Policy:
    """Labels of the nearest records (store: record_id, symbol, timeframe, timestamp, label, embedding) of the event's symbol and timeframe; those
    that aren't older than the event don't count, but take a place among the k."""

    def run(events: DataFrame) -> DataFrame:
        asked = events.select("event_id", "symbol", "timeframe", F.col("embedding").alias("query"))
        near = vectors.search_by_key(asked, store, ["symbol", "timeframe"], k, ids=("event_id", "record_id")).join(events.select("event_id", F.col("timestamp").alias("event_ts")), "event_id")
        return backtest.neighbour_signals(near, events.select("event_id"), cfg).select("event_id", "p_long", "direction", "confidence")

    return run


def compare(records: DataFrame, candles: DataFrame, policies: dict[str, Policy], cfg: backtest.BacktestConfig = backtest.BacktestConfig(), max_events: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Every policy over one series' records: (ranked metrics, trades taken, equity curve). candles: the execution series.

    Events from the quantile of time `cfg.eval_fraction` on are traded, the first `max_events` of them in the order of time, which is also the
    most trades that a policy takes. A policy with an attribute `context` (sequences of that many earlier events) sees the events before the first
    traded one as well, and all that follow: what limits it is the number of trades.
    """
    order = ["timestamp", "pattern_type", "symbol", "timeframe"]
    events = written(records.select("symbol", "timeframe", "timestamp", "pattern_type", "embedding").withColumn("event_id", F.xxhash64(*order)), "events")
    start = backtest.evaluation_start(events.withColumn("policy", F.lit("")), cfg.eval_fraction).first()["eval_start"]
    later = events.where(F.col("timestamp") >= F.lit(start))
    traded = written(later.orderBy(*order).limit(max_events), "traded-events") if max_events is not None else later
    first = traded.agg(F.min("timestamp")).first()[0]
    signals = None
    for name, policy in policies.items():
        context = getattr(policy, "context", 0)
        mine = traded
        if context:
            earlier = events.where(F.col("timestamp") < F.lit(first)).orderBy(*[F.desc(c) for c in order]).limit(context)
            mine = later.where(F.col("timestamp") >= F.lit(first)).unionByName(earlier)
        found = policy(mine).join(later.select("event_id", "symbol", "timestamp", "pattern_type"), "event_id").withColumn("policy", F.lit(name))
        signals = found if signals is None else signals.unionByName(found)
    signals = written(signals, "signals")
    cfg = cfg if max_events is None else replace(cfg, max_trades=max_events)
    starts = candles.sparkSession.createDataFrame([(n, start) for n in policies], "policy string, eval_start long")
    taken = written(backtest.portfolio(backtest.trades(signals, of_one_exchange(candles, []), cfg), starts, cfg), "trades-taken")
    curve = backtest.equity_curve(taken, starts, cfg)
    return backtest.ranked(backtest.metrics(taken, curve, cfg)), taken, curve


#: What a cycle trains, and the length of the windows of each kind.
KINDS = {"model": 1, "sequence": 12}


def train_kinds(rows: DataFrame, folder: str, kinds: dict[str, int] = KINDS, horizon: str = "1h") -> dict[str, dict[str, object]]:
    """Trains each kind of model as folder/candidate/<kind>; the scores."""
    return {k: train(rows, f"{folder}/candidate/{k}", horizon, length=n) for k, n in kinds.items()}


def promote(spark: SparkSession, rows: DataFrame, execution: DataFrame, folder: str, cycle: int, cfg: backtest.BacktestConfig = backtest.BacktestConfig(), max_events: int = 30, kinds: dict[str, int] = KINDS) -> dict[str, bool]:
    """Which of the models in folder/candidate/<kind> replace those in folder/champion/<kind>: each by a comparison over the same events of a series.

    Decisions and all models' metrics are written to folder/cycles/<number>/promotion (JSON); a promoted model is copied.
    """
    fs = lambda p: spark._jvm.org.apache.hadoop.fs.Path(p)
    conf = spark._jsc.hadoopConfiguration()
    there = lambda p: fs(p).getFileSystem(conf).exists(fs(p))
    made = {f"{side} {k}": f"{folder}/{side}/{k}" for k in kinds for side in ("champion", "candidate") if side == "candidate" or there(f"{folder}/champion/{k}/meta")}
    policies = {n: (sequence_policy if kinds[n.split()[1]] > 1 else model_policy)(load(spark, p), cfg) for n, p in made.items()}
    found = written(compare(rows, execution, policies, cfg, max_events)[0], "promotion-metrics")
    side = lambda s: found.where(F.col("policy").startswith(s)).withColumn("policy", F.split("policy", " ")[1])
    wins = {r.policy: bool(r.promote) for r in backtest.promoted(side("champion"), side("candidate")).collect()}
    result = {"cycle": cycle, "promote": wins, **{r.policy: r.asDict() for r in found.drop("place").collect()}}
    spark.range(1).select(F.lit(json.dumps(result)).alias("value")).coalesce(1).write.mode("overwrite").text(f"{folder}/cycles/{cycle}/promotion")
    for k in (k for k, w in wins.items() if w):
        source, path = fs(f"{folder}/candidate/{k}"), fs(f"{folder}/champion/{k}")
        path.getFileSystem(conf).delete(path, True)
        path.getFileSystem(conf).mkdirs(path.getParent())
        spark._jvm.org.apache.hadoop.fs.FileUtil.copy(source.getFileSystem(conf), source, path.getFileSystem(conf), path, False, conf)
    return wins
