"""The registered queries: one per operator or tight family, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from candlewick.functions import scalars
from candlewick.operators import backtest, candlestick, chart, datasets, geometry, indicators, labeling, models, simulate, training, vector_store, vectors
from candlewick.plans.planted import blocks, planted
from candlewick.session import scratch_path, written
from candlewick.sources import candles

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
#: Patterns that have a label and a signal in the queries: bullish ones long, bearish ones short.
CFG = backtest.BacktestConfig(eval_fraction=0.5, horizon_steps=3)


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def _rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, for comparison."""
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def _h4(spark: SparkSession, d: str) -> DataFrame:
    return candles.from_events(spark, d, "4h")


def _patterns(spark: SparkSession, d: str, timeframe: str = "4h") -> DataFrame:
    return candlestick.best(candlestick.detect(candles.from_events(spark, d, timeframe)))


@query
def candles_events(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(_h4(spark, d).select("symbol", "timeframe", "timestamp", "open", "high", "low", "close", "volume"))


@query
def candles_daily(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(candles.daily(spark, d).select("symbol", "timestamp", "open", "high", "low", "close", "volume"))


@query
def candle_upsert(spark: SparkSession, d: str) -> DataFrame:
    """Every second bar arrives again with a later sequence and other prices; the last write wins."""
    stored = _h4(spark, d).withColumn("ingest_seq", F.lit(0))
    again = stored.where(F.col("timestamp") % (2 * scalars.tf_to_ms("4h")) == 0).withColumn("close", F.col("close") + 1).withColumn("ingest_seq", F.lit(1))
    older = stored.withColumn("close", F.col("close") - 5).withColumn("ingest_seq", F.lit(-1))
    return _rounded(candles.upserted(stored, again.unionByName(older)).select("symbol", "timestamp", "open", "close", "volume"))


@query
def candle_latest(spark: SparkSession, d: str) -> DataFrame:
    """S6."""
    return candles.latest(_h4(spark, d)).select("symbol", "latest", F.col("n").alias("n_candles"))


@query
def candle_range_scan(spark: SparkSession, d: str) -> DataFrame:
    """Two stored series between two times."""
    path = scratch_path(spark, "candles")
    candles.store(candles.from_events(spark, d, "1h"), path)
    each = [candles.scan(spark, path, "local", symbol, "1h", 1704412800000, 1705017600000) for symbol in ("click", "purchase")]
    return _rounded(each[0].unionByName(each[1]).select("symbol", "timestamp", "close"))


@query
def pick_exchange(spark: SparkSession, d: str) -> DataFrame:
    """The first exchange lacks the hourly series of two symbols."""
    base = candles.from_events(spark, d, "1h").unionByName(_h4(spark, d))
    first = base.where("timeframe = '4h' OR symbol NOT IN ('click', 'view')").withColumn("exchange", F.lit("first"))
    return candles.pick_exchange(first.unionByName(base.withColumn("exchange", F.lit("second"))), ["1h", "4h"], ["first", "second"])


@query
def closed_candles(spark: SparkSession, d: str) -> DataFrame:
    """T2."""
    return candles.closed(_h4(spark, d), 1706400000000).select("symbol", "closed_ts")


@query
def atr_series(spark: SparkSession, d: str) -> DataFrame:
    """W1, W2, W4."""
    return _rounded(indicators.with_atr(_h4(spark, d)).select("symbol", "timestamp", "tr", "atr"))


@query
def event_context(spark: SparkSession, d: str) -> DataFrame:
    """W5-W7."""
    return _rounded(indicators.at_event(_h4(spark, d)).select("symbol", "timestamp", "atr_event", "atr_pct", "regime", "vol_mean", "vol_std", "vol_z"), 4)


@query
def trend_slope(spark: SparkSession, d: str) -> DataFrame:
    """W8, A6."""
    df = indicators.with_atr(candles.daily(spark, d)).select("*", indicators.trend_slope().alias("slope"))
    return _rounded(df.select("symbol", "timestamp", "slope"), 3)


@query
def market_features(spark: SparkSession, d: str) -> DataFrame:
    """W11."""
    return _rounded(indicators.market_features(_h4(spark, d)).select("symbol", "timestamp", "ret_1", "ret_3", "ret_5", "sma_rel", "vol_rel"))


@query
def drawdown_curve(spark: SparkSession, d: str) -> DataFrame:
    """W14, with the closes as equity."""
    return _rounded(indicators.drawdowns(candles.daily(spark, d), "symbol", "timestamp", "close").select("symbol", "timestamp", "drawdown"))


@query
def candlestick_patterns(spark: SparkSession, d: str) -> DataFrame:
    """C1-C28 on daily and four-hour series."""
    both = candles.daily(spark, d).unionByName(_h4(spark, d))
    return candlestick.detect(both).select("symbol", "timeframe", "timestamp", "pattern_type", "direction", "confidence")


@query
def candlestick_features(spark: SparkSession, d: str) -> DataFrame:
    """What each pattern reports of itself. Shares of a range without extent are huge, so the magnitude is given too."""
    both = candles.daily(spark, d).unionByName(_h4(spark, d))
    each = candlestick.detect(both).select("symbol", "timeframe", "timestamp", "pattern_type", "direction", F.explode("features").alias("feature", "value"))
    return _rounded(each.select("*", F.log10(1 + F.col("value")).alias("magnitude")).withColumn("value", F.when(F.col("value") < 1e6, F.col("value"))))


@query
def pattern_dedup(spark: SparkSession, d: str) -> DataFrame:
    """D1."""
    return _patterns(spark, d).select("symbol", "timeframe", "timestamp", "pattern_type", "confidence")


@query
def two_bar_counts(spark: SparkSession, d: str) -> DataFrame:
    """Which two-bar patterns occur, and how often."""
    found = candlestick.detect(_h4(spark, d)).where(F.col("pattern_type").isin("BullishEngulfing", "BearishEngulfing", "InsideBar"))
    return found.groupBy("symbol", "pattern_type", "direction").agg(F.count(F.lit(1)).alias("n"))


@query
def forward_returns(spark: SparkSession, d: str) -> DataFrame:
    """Events between bars take the next one."""
    series = labeling.forward_returns(candles.from_events(spark, d, "1h"))
    events = _h4(spark, d).select("symbol", (F.col("timestamp") + 1_800_000).alias("timestamp"))
    return _rounded(labeling.next_at_or_after(events, series, ["symbol"], ["fwd_1h", "fwd_4h", "fwd_24h"]))


def _labelled(spark: SparkSession, d: str) -> DataFrame:
    return labeling.label(_patterns(spark, d), candles.from_events(spark, d, "1h"))


@query
def pattern_labels(spark: SparkSession, d: str) -> DataFrame:
    """W12, W13, J9."""
    return _rounded(_labelled(spark, d).select("symbol", "timeframe", "timestamp", "pattern_type", "fwd_1h", "fwd_4h", "fwd_24h", "label_score", "label"))


@query
def timeframe_alignment(spark: SparkSession, d: str) -> DataFrame:
    """Four-hour patterns and their hourly counterparts."""
    both = _patterns(spark, d).unionByName(_patterns(spark, d, "1h")).select("symbol", "timeframe", "timestamp", "pattern_type", "confidence")
    return _rounded(labeling.aligned(both, "4h", "1h", scalars.tf_to_ms("1h")).select("symbol", "timestamp", "pattern_type", "matches", "boosted"))


@query
def pattern_hash(spark: SparkSession, d: str) -> DataFrame:
    """G1, G2, of the patterns that occur."""
    names = _patterns(spark, d).select("pattern_type").distinct()
    return names.select("pattern_type", *[F.expr(scalars.md5_mod24(f"concat(pattern_type, '|{i}')")).alias(f"h{i}") for i in range(6)], F.size(F.filter(scalars.multi_hot("pattern_type"), lambda x: x > 0)).alias("n_hot"))


def _embedded(spark: SparkSession, d: str) -> DataFrame:
    ctx = indicators.at_event(_h4(spark, d)).select("symbol", "timeframe", "timestamp", "atr_pct", "regime", "vol_z")
    curve = geometry.with_curve(_h4(spark, d)).select("symbol", "timeframe", "timestamp", "seg")
    df = _patterns(spark, d).join(ctx, ["symbol", "timeframe", "timestamp"]).join(curve, ["symbol", "timeframe", "timestamp"])
    return geometry.embedded(geometry.merged(geometry.enriched(df)))


@query
def curve_geometry(spark: SparkSession, d: str) -> DataFrame:
    """G3-G8."""
    df = geometry.enriched(geometry.with_curve(_h4(spark, d)))
    return _rounded(df.select("symbol", "timestamp", "curvature_mean", "slope_mean", "shape_dtw_to_u", "shape_dtw_to_invu"), 5)


@query
def pattern_embedding(spark: SparkSession, d: str) -> DataFrame:
    """The 64 numbers."""
    return _rounded(_embedded(spark, d).select("symbol", "timestamp", "pattern_type", F.posexplode("embedding").alias("place", "value")), 5)


def _store(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/embeddings.parquet").select(F.col("vec_id").alias("record_id"), "embedding", "label")


@query
def vector_topk(spark: SparkSession, d: str) -> DataFrame:
    """The ids divisible by 100 ask all rows of label 1, 2 or 3."""
    store = _store(spark, d)
    asked = store.where("record_id % 100 = 0").select(F.col("record_id").alias("query_id"), F.col("embedding").alias("query"))
    got = vectors.search(asked, store.where(F.col("label").isin(1, 2, 3)), 10)
    return got.select("query_id", "record_id", "rank", F.round("similarity", 5).alias("similarity"))


@query
def vector_late_filter(spark: SparkSession, d: str) -> DataFrame:
    """Filters after the k are taken leave fewer."""
    store = _store(spark, d)
    asked = store.where("record_id % 100 = 0").select(F.col("record_id").alias("query_id"), F.col("embedding").alias("query"))
    got = vectors.search(asked, store, 20, after=(F.col("label") == 1) & (F.col("record_id") != F.col("query_id")))
    return got.select("query_id", "record_id", "rank")


@query
def vector_upsert(spark: SparkSession, d: str) -> DataFrame:
    """V2, S12-S14."""
    store = _store(spark, d)
    new = store.where("record_id % 3 = 0").withColumn("label", F.lit(99)).unionByName(store.limit(0).withColumn("label", F.lit(99)))
    return vectors.upsert(store, new).groupBy("label").agg(F.count(F.lit(1)).alias("n"))


def _reversed(spark: SparkSession, d: str) -> DataFrame:
    """Of the ids that 3 divides, the vectors backwards, with label 99."""
    return _store(spark, d).where("record_id % 3 = 0").withColumn("label", F.lit(99)).withColumn("embedding", F.reverse("embedding"))


@query
def vector_store_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """A store is created, upserted, cut by ids and opened anew; its rows number by number."""
    path = scratch_path(spark, "vector-store")
    store = vector_store.VectorStore(spark, path, 64, buckets=16)
    store.overwrite(_store(spark, d).where("record_id % 2 = 0"))
    store.upsert(_reversed(spark, d))
    store.delete(_store(spark, d).where("record_id % 10 = 4"))
    return vector_store.VectorStore(spark, path).rows().select("record_id", "label", F.posexplode(F.col("embedding").cast("array<double>")).alias("place", "value"))


@query
def vector_index_topk(spark: SparkSession, d: str) -> DataFrame:
    """V3, V4: the ids divisible by 100 ask all rows of an inverted-file index, which passes over cells that can't hold a better row only."""
    store = _store(spark, d)
    index = vector_store.InvertedIndex.build(store, scratch_path(spark, "vector-index"))
    asked = store.where("record_id % 100 = 0").select(F.col("record_id").alias("query_id"), F.col("embedding").alias("query"))
    return index.search(asked, 10, exact=True).select("query_id", "record_id", "rank", F.round("similarity", 5).alias("similarity"))


@query
def vector_ann_topk(spark: SparkSession, d: str) -> DataFrame:
    """V4: the same with the nearest cells alone, as many as find 95 % on a sample; tests hold its recall against all rows."""
    store = _store(spark, d)
    index = vector_store.InvertedIndex.build(store, scratch_path(spark, "vector-index"))
    asked = store.where("record_id % 100 = 0").select(F.col("record_id").alias("query_id"), F.col("embedding").alias("query"))
    return index.search(asked, 10, probes=index.probes_for(0.95)).select("query_id", "record_id", "rank", F.round("similarity", 5).alias("similarity"))


def _series_events(spark: SparkSession, d: str) -> DataFrame:
    """Vectors as records of several symbols and timeframes, with ids as times."""
    label = F.when(F.col("label") < 4, "Good").when(F.col("label") < 8, "Bad").otherwise("Neutral")
    df = _store(spark, d).withColumn("symbol", F.concat(F.lit("s"), F.col("record_id") % 3)).withColumn("timeframe", F.when(F.col("record_id") % 4 == 0, "4h").otherwise("1h"))
    return df.select("record_id", "symbol", "timeframe", F.col("record_id").alias("timestamp"), label.alias("label"), "embedding")


@query
def neighbours_by_series(spark: SparkSession, d: str) -> DataFrame:
    """Every vector's ten nearest ones of its own symbol and timeframe."""
    store = _series_events(spark, d)
    asked = store.select(F.col("record_id").alias("query_id"), "symbol", "timeframe", F.col("embedding").alias("query"))
    return vectors.search_by_key(asked, store, ["symbol", "timeframe"], 10).select("query_id", "symbol", "timeframe", "record_id", "rank", F.round("similarity", 5).alias("similarity"))


@query
def similarity_policy(spark: SparkSession, d: str) -> DataFrame:
    """B3 with several symbols and timeframes: only older neighbours of the event's own series vote."""
    store = _series_events(spark, d)
    return _rounded(training.similarity_policy(store, 20)(store.withColumn("event_id", F.col("record_id"))), 4)


def _two_exchanges(spark: SparkSession, d: str) -> DataFrame:
    """Hourly and four-hour candles on two exchanges whose prices differ; the first one lacks the hourly candles of two symbols."""
    base = candles.from_events(spark, d, "1h").unionByName(_h4(spark, d))
    first = base.where("timeframe = '4h' OR symbol NOT IN ('click', 'view')").withColumn("exchange", F.lit("first"))
    return first.unionByName(base.withColumn("exchange", F.lit("second")).withColumns({c: F.col(c) * 3 + F.col("timestamp") % 7 for c in ("open", "high", "low", "close")}))


@query
def forward_returns_by_exchange(spark: SparkSession, d: str) -> DataFrame:
    """W10, J1 where several exchanges have a symbol: each event looks at its own one."""
    both = _two_exchanges(spark, d)
    events = both.where("timeframe = '4h'").select("exchange", "symbol", (F.col("timestamp") + 1_800_000).alias("timestamp"))
    return _rounded(labeling.next_at_or_after(events, labeling.forward_returns(both.where("timeframe = '1h'")), ["exchange", "symbol"], ["fwd_1h", "fwd_4h", "fwd_24h"]))


@query
def candles_of_one_exchange(spark: SparkSession, d: str) -> DataFrame:
    """S20 before building: each symbol's candles on the first exchange that has both timeframes."""
    return _rounded(candles.of_one_exchange(_two_exchanges(spark, d), ["1h", "4h"], ["first", "second"]).select("exchange", "symbol", "timeframe", "timestamp", "close"))


@query
def chart_pivots(spark: SparkSession, d: str) -> DataFrame:
    """H1 on daily series."""
    s = chart.with_pivots(chart.segments(candles.daily(spark, d)))
    each = lambda side: s.select("symbol", F.lit(side).alias("side"), F.inline(side))
    return _rounded(each("hi").unionByName(each("lo")).select("symbol", "side", F.col("i").alias("idx"), F.col("p").alias("price")))


@query
def chart_patterns(spark: SparkSession, d: str) -> DataFrame:
    """H2-H24 on daily and hourly series."""
    found = chart.detect(candles.daily(spark, d).unionByName(candles.from_events(spark, d, "1h", by_type=False)))
    return _rounded(found.drop("exchange"))


def _signals(spark: SparkSession, d: str) -> DataFrame:
    """Bullish patterns long, bearish ones short, with a probability from the confidence."""
    found = _patterns(spark, d).where("direction <> 'neutral'")
    p = F.when(F.col("direction") == "bullish", 0.3 + F.col("confidence") / 2).otherwise(0.7 - F.col("confidence") / 2)
    df = found.select("symbol", "timestamp", "pattern_type", p.alias("p_long")).withColumn("policy", F.concat(F.lit("p-"), F.col("symbol")))
    df = df.withColumn("direction", backtest.direction(F.col("p_long"), CFG))
    return df.withColumn("confidence", F.greatest("p_long", 1 - F.col("p_long")))


@query
def signal_thresholds(spark: SparkSession, d: str) -> DataFrame:
    """B1, B2."""
    return _rounded(_signals(spark, d).select("symbol", "timestamp", "pattern_type", "p_long", "direction"))


def _possible(spark: SparkSession, d: str) -> DataFrame:
    return backtest.trades(_signals(spark, d), candles.from_events(spark, d, "1h"), CFG)


@query
def backtest_trades(spark: SparkSession, d: str) -> DataFrame:
    """B5, B5b, J2."""
    return _rounded(_possible(spark, d).select("policy", "timestamp", "pattern_type", "direction", "exit_ts", "exit_reason", "entry_price", "exit_price", "regime", "sl_raw", "tp_raw", "share"))


@query
def evaluation_start(spark: SparkSession, d: str) -> DataFrame:
    """A4."""
    return backtest.evaluation_start(_signals(spark, d), CFG.eval_fraction)


def _taken(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Signals and trades are written once: starts, trades, curves and metrics read them."""
    signals = written(_signals(spark, d), "signals")
    starts = backtest.evaluation_start(signals, CFG.eval_fraction)
    return written(backtest.portfolio(backtest.trades(signals, candles.from_events(spark, d, "1h"), CFG), starts, CFG), "taken"), starts


@query
def backtest_portfolio(spark: SparkSession, d: str) -> DataFrame:
    """Trades without overlap, and equity."""
    taken, _ = _taken(spark, d)
    return _rounded(taken.select("policy", "number", "timestamp", "exit_ts", "pattern_type", "equity", "net_pnl"), 4)


@query
def backtest_metrics(spark: SparkSession, d: str) -> DataFrame:
    """A8, W14, B8."""
    taken, starts = _taken(spark, d)
    return _rounded(backtest.metrics(taken, backtest.equity_curve(taken, starts, CFG), CFG), 4)


@query
def rank_policies(spark: SparkSession, d: str) -> DataFrame:
    """O5, B9."""
    taken, starts = _taken(spark, d)
    found = backtest.metrics(taken, backtest.equity_curve(taken, starts, CFG), CFG)
    return backtest.ranked(found).select("policy", F.col("place").cast("long").alias("place"), "trade_count")


@query
def promotion_gate(spark: SparkSession, d: str) -> DataFrame:
    """Each policy challenges itself with less risk."""
    taken, starts = _taken(spark, d)
    found = written(backtest.metrics(taken, backtest.equity_curve(taken, starts, CFG), CFG), "metrics")
    weaker = found.withColumn("sharpe", F.col("sharpe") + F.when(F.col("policy") == "p-click", -1.0).otherwise(1.0))
    return backtest.promoted(found.where("policy <> 'p-view'"), weaker)


@query
def neighbour_policy(spark: SparkSession, d: str) -> DataFrame:
    """Labels of the nearest earlier vectors decide."""
    store = _store(spark, d).withColumn("timestamp", F.col("record_id")).withColumn("label", F.when(F.col("label") < 4, "Good").when(F.col("label") < 8, "Bad").otherwise("Neutral"))
    asked = store.where("record_id % 100 = 0").select(F.col("record_id").alias("query_id"), F.col("embedding").alias("query"))
    near = vectors.search(asked, store, 20).withColumnRenamed("query_id", "event_id").withColumn("event_ts", F.col("event_id"))
    return _rounded(backtest.neighbour_signals(near, asked.select(F.col("query_id").alias("event_id"))), 4)


@query
def balanced_cap(spark: SparkSession, d: str) -> DataFrame:
    """The newest 60 rows at most, half of each label."""
    got = datasets.recent_balanced(_labelled(spark, d), 60)
    return got.select("symbol", "timestamp", "pattern_type", "label", datasets.label_number(F.col("label")).alias("y_dir"))


@query
def sequence_windows(spark: SparkSession, d: str) -> DataFrame:
    """Six events a window, every second one."""
    rows = _labelled(spark, d).where("label <> 'Neutral'").withColumn("embedding", F.array(F.col("label_score")))
    got = datasets.sequences(rows, 6, 2)
    return got.select("symbol", "ts_end", "pattern_type", F.size("window").alias("length"), F.round(F.expr("aggregate(window, 0D, (a, x) -> a + x[0])"), 5).alias("total"))


@query
def time_split(spark: SparkSession, d: str) -> DataFrame:
    """W16."""
    return datasets.time_split(_labelled(spark, d)).groupBy(F.coalesce("split", F.lit("none")).alias("split")).agg(F.count(F.lit(1)).alias("n"), F.min("timestamp").alias("first"), F.max("timestamp").alias("last"))


@query
def classification_scores(spark: SparkSession, d: str) -> DataFrame:
    """The label score against whether the next hour rises."""
    rows = _labelled(spark, d).where("fwd_1h IS NOT NULL").select((F.col("fwd_1h") > 0).cast("int").alias("y"), F.round("label_score", 6).alias("p"))
    return _rounded(datasets.classification_scores(rows))


@query
def regression_scores(spark: SparkSession, d: str) -> DataFrame:
    rows = _labelled(spark, d).where("fwd_4h IS NOT NULL").select(F.col("fwd_4h").alias("y"), F.col("fwd_1h").alias("p"))
    return _rounded(datasets.regression_scores(rows), 4)


@query
def standardised(spark: SparkSession, d: str) -> DataFrame:
    """L3."""
    return _rounded(datasets.standardised(_h4(spark, d).select("symbol", "timestamp", "close", "volume"), ["close", "volume"]), 4)


@query
def training_table(spark: SparkSession, d: str) -> DataFrame:
    """L1, P9, P10."""
    rows = _labelled(spark, d).where(F.col("label").isin("Good", "Bad") & F.col("fwd_4h").isNotNull() & ~F.isnan("fwd_4h"))
    return _rounded(rows.select("symbol", "timestamp", "pattern_type", datasets.label_number(F.col("label")).alias("y_dir"), F.col("fwd_4h").alias("y_return")))


@query
def model_scores(spark: SparkSession, d: str) -> DataFrame:
    """Vectors of labels below 5 against the others; trained on four fifths, scored on all."""
    rows = _store(spark, d).select("record_id", "embedding", (F.col("label") < 5).cast("int").alias("y_dir"), F.col("label").cast("double").alias("y_return"))
    train = rows.where("record_id % 5 > 0")
    direction = models.direction_model(models.scaled(train, "embedding"), balanced=True)
    returns = models.return_model(models.scaled(train, "embedding"))
    scored = returns.transform(models.probability(direction, models.scaled(rows, "embedding", train)))
    return scored.select("record_id", "y_dir", F.round("p", 4).alias("p"), F.round("prediction", 4).alias("expected"))


@query
def environment_episode(spark: SparkSession, d: str) -> DataFrame:
    """A scripted episode over the hourly bars of every symbol, from the first one whose features are whole."""
    bars = indicators.with_atr(candles.from_events(spark, d, "1h")).where("idx >= 40").withColumn("action", (F.col("idx") % 7 == 0).cast("int") + 2 * (F.col("idx") % 7 == 4).cast("int"))
    return _rounded(simulate.episode(bars.select("symbol", F.col("idx").cast("int").alias("idx"), "high", "low", "close", "atr", "action")), 4)


@query
def scalar_functions(spark: SparkSession, d: str) -> DataFrame:
    """M1-M6: durations, times, ids, JSON."""
    df = _h4(spark, d).withColumn("symbol", F.concat("symbol", F.lit("/USDT")))
    return df.select(
        "symbol", "timestamp", scalars.tf_to_ms_column(F.col("timeframe")).alias("ms"), scalars.iso_utc(F.col("timestamp")).alias("iso"), scalars.file_symbol(F.col("symbol")).alias("file"),
        scalars.record_id("symbol", "timeframe", "timestamp").alias("record_id"), F.bround(F.col("volume") / 2, 0).alias("half"), F.get_json_object(F.to_json(F.struct("timestamp", "symbol")), "$.symbol").alias("from_json"),
    )


@query
def ohlcv_decode(spark: SparkSession, d: str) -> DataFrame:
    """Candles as JSON arrays of strings, decoded."""
    raw = _h4(spark, d).select(F.to_json(F.array(*[F.col(c).cast("string") for c in ("timestamp", "open", "high", "low", "close", "volume")])).alias("payload"))
    return _rounded(candles.validated(candles.decoded(raw, "payload", "local", "ALL", "4h"), strict=True).select("timestamp", "open", "high", "low", "close", "volume"))


#: H2: the numbers of a chart pattern's curve.
_CURVE = ("slope_mean", "curvature_mean")


def _curved(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.round(c, 8) for c in _CURVE})


def _chart_series(spark: SparkSession, d: str) -> DataFrame:
    return chart.with_pivots(chart.segments(candles.daily(spark, d)))


@query
def chart_swings(spark: SparkSession, d: str) -> DataFrame:
    """H3-H8, J6-J8 on daily series."""
    return _curved(chart.swings(_chart_series(spark, d)).select("symbol", "timestamp", "pattern_type", "direction", F.round("confidence", 6).alias("confidence"), F.round("neckline", 6).alias("neckline"), *_CURVE))


@query
def chart_last_pivots(spark: SparkSession, d: str) -> DataFrame:
    """H9-H14, H18."""
    return _curved(chart.by_last_pivots(_chart_series(spark, d)).select("symbol", "timestamp", "pattern_type", "direction", "confidence", *_CURVE))


@query
def chart_last_candles(spark: SparkSession, d: str) -> DataFrame:
    """H15-H17, H20-H24, A7, on daily and hourly series."""
    both = candles.daily(spark, d).unionByName(candles.from_events(spark, d, "1h"))
    return _curved(chart.by_last_candles(chart.segments(both)).select("symbol", "timestamp", "pattern_type", "direction", "confidence", *_CURVE))


def _planted(spark: SparkSession, d: str, curves: bool) -> DataFrame:
    """Series over blocks of lineitem's days that make the families fire which real ones rarely do."""
    made = spark.sql(planted(blocks(f"parquet.`{d}/lineitem.parquet`"), curves))
    return made.select(F.lit("local").alias("exchange"), "symbol", "timeframe", F.col("timestamp").cast("long").alias("timestamp"), "open", "high", "low", "close", "volume")


@query
def chart_planted_pivots(spark: SparkSession, d: str) -> DataFrame:
    """H9-H14, H18 on planted series."""
    return _curved(chart.by_last_pivots(chart.with_pivots(chart.segments(_planted(spark, d, False)))).select("symbol", "timestamp", "pattern_type", "direction", "confidence", *_CURVE))


@query
def chart_planted_candles(spark: SparkSession, d: str) -> DataFrame:
    """H15-H17, H23, H24 on planted series."""
    return _curved(chart.by_last_candles(chart.segments(_planted(spark, d, True))).select("symbol", "timestamp", "pattern_type", "direction", "confidence", *_CURVE))


@query
def chart_retests(spark: SparkSession, d: str) -> DataFrame:
    """H19, with prices drawn together so that ranges are narrow, and a rise so that they are broken."""
    calm = candles.from_events(spark, d, "1h").select("exchange", "symbol", "timeframe", "timestamp", *[(F.col(c) / 2000 + 100 + F.col("timestamp") % 2592000000 / 720000000).alias(c) for c in ("open", "high", "low", "close")], "volume")
    return _curved(chart.retests(chart.segments(calm)).select("symbol", "timestamp", "pattern_type", "direction", "confidence", *_CURVE))
