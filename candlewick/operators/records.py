"""Pattern records: every detected pattern with its context, geometry, label and embedding."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candlewick.functions.scalars import tf_to_ms
from candlewick.operators import candlestick, chart, geometry, indicators, labeling
from candlewick.session import written
from candlewick.sources.candles import of_one_exchange

EVENT = ["exchange", "symbol", "timeframe", "timestamp", "pattern_type"]
COLUMNS = ["symbol", "timeframe", "timestamp", "pattern_type", "label", "detector_features", "geometry_metrics", "volatility_context", "volume_context", "forward_returns", "embedding", "confidence"]


def instances(candles: DataFrame) -> DataFrame:
    """Candlestick and chart patterns of all series, the best of each type at a candle, with features and geometry."""
    keep = [*EVENT, "direction", "confidence", "features", "geometry"]
    found = candlestick.detect(candles).select(*keep, F.lit(0).alias("detector")).unionByName(chart.detect(candles).select(*keep, F.lit(1).alias("detector")))
    return candlestick.best(found)


def raised(found: DataFrame, timeframes: list[str]) -> DataFrame:
    """found with the confidence of the first timeframe's instances raised by the second one's at about the same time."""
    if len(timeframes) < 2:
        return found
    narrow = found.select(*EVENT, "confidence")
    more = labeling.aligned(narrow, timeframes[0], timeframes[1], tf_to_ms(timeframes[1])).where("matches > 0")
    return found.join(more.select(*EVENT, "boosted"), EVENT, "left").withColumn("confidence", F.coalesce("boosted", "confidence")).drop("boosted")


def build(candles: DataFrame, timeframes: list[str], labels: str = "1h", cfg: labeling.LabelingConfig = labeling.LabelingConfig(), exchanges: list[str] | None = None) -> DataFrame:
    """The records (COLUMNS) of the candles in `timeframes`, labelled by the series in timeframe `labels`.

    Each symbol's candles are those of one exchange: the first of `exchanges` (by default all, by name) that has all these timeframes. A symbol's
    records don't depend on which other symbols are there: labels rank its own instances.

    Instances are written once, as alignment, context and labels each read them. Instances without a label candle are Neutral and have no
    returns. A candle that is in no series (there is none by construction) would give no record.
    """
    candles = of_one_exchange(candles, sorted({labels, *timeframes}), exchanges)
    wanted = candles.where(F.col("timeframe").isin(timeframes))
    found = written(instances(wanted), "pattern-instances")
    at = EVENT[:4]
    context = indicators.at_event(wanted).select(*at, "atr_event", "atr_pct", "regime", "vol_mean", "vol_z")
    curve = geometry.with_curve(wanted).select(*at, "seg")
    df = raised(found, timeframes).join(context, at).join(curve, at)
    df = geometry.merged(geometry.enriched(df))
    # The raised confidence is the record's; the geometry keeps what the detector gave.
    df = geometry.embedded(df)
    names = [f"fwd_{h}" for h in cfg.horizons]
    narrow = found.select(*EVENT, "confidence")
    group = ["exchange", "symbol", "pattern_type", "timeframe"]
    label = labeling.label(narrow, candles.where(F.col("timeframe") == labels), cfg, group).select(*EVENT, "label", *names)
    returns = F.map_filter(F.create_map(*[x for h in cfg.horizons for x in (F.lit(h), F.col(f"fwd_{h}"))]), lambda _, v: v.isNotNull())
    df = df.join(label, EVENT)
    return df.select(
        "symbol", "timeframe", "timestamp", "pattern_type", "label", F.col("features").alias("detector_features"), F.col("geometry").alias("geometry_metrics"),
        F.struct(F.col("atr_event").alias("atr"), F.col("atr_pct").alias("atr_percent"), "regime").alias("volatility_context"),
        F.create_map(F.lit("volume_mean"), "vol_mean", F.lit("volume_z"), "vol_z").alias("volume_context"), returns.alias("forward_returns"), "embedding", "confidence",
    )
