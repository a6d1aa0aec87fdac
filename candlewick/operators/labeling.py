"""Forward returns and leak-free labels.

An event looks up the first label candle at or after it; its returns are those 1, 4 and 24 label rows later. Its rank at a horizon is
taken only among events of its pattern and timeframe whose horizon had passed: the share with no larger return, 0.5 without any.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from candlewick.operators import slices

HOUR = 3_600_000


@dataclass(frozen=True)
class LabelingConfig:
    horizons: dict[str, int] = field(default_factory=lambda: {"1h": 1, "4h": 4, "24h": 24})
    weights: dict[str, float] = field(default_factory=lambda: {"1h": 0.2, "4h": 0.3, "24h": 0.5})
    good: float = 0.8
    bad: float = 0.2


def next_at_or_after(events: DataFrame, series: DataFrame, key: list[str], payload: list[str], short: int | None = None, length: int = slices.SLICE) -> DataFrame:
    """As-of join: each event with the payload of the first series row at or after it (null past the end).

    Union and a window by key, so events and series are shuffled once, and neither side is broadcast or ranged over. The window runs from the
    newest row back and only ever adds a row to its frame, so a series takes linear time. With `short`, keys are counted, and if one has
    more rows than that, keys are cut into slices, each of which gets the payload that the slices before (later in time) end with.
    """
    e = events.withColumn("__e", F.lit(1))
    for c in payload:
        e = e.withColumn(c, F.lit(None).cast(series.schema[c].dataType))
    s = series.select(*key, "timestamp", *payload).withColumn("__e", F.lit(0))
    for c in events.columns:
        if c not in s.columns:
            s = s.withColumn(c, F.lit(None).cast(events.schema[c].dataType))
    both = e.unionByName(s.select(*e.columns))
    order, hit = [F.desc("timestamp"), F.asc("__e")], F.when(F.col("__e") == 0, F.struct(*payload))
    if slices.is_long(series, key, short):
        both = slices.sliced(both, key, ["-timestamp", "__e"], length)
        last = F.max_by(F.struct(*payload), F.when(F.col("__e") == 0, -F.col("timestamp")))  # keys and times of a series are unique
        both = slices.carried(both, key, {"__last": last}, {"__from": F.last("__last", ignorenulls=True)})
        w = slices.within(key).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
        df = both.withColumn("__f", F.coalesce(F.last(hit, ignorenulls=True).over(w), F.col("__from")))
    else:
        w = W.partitionBy(*key).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
        df = both.withColumn("__f", F.last(hit, ignorenulls=True).over(w))
    return df.where("__e = 1").select(*events.columns, *[F.col(f"__f.{c}").alias(c) for c in payload])


def series_key(*frames: DataFrame) -> list[str]:
    """What tells series of a timeframe apart: exchange, where all frames have it, and symbol."""
    return [*(["exchange"] if all("exchange" in f.columns for f in frames) else []), "symbol"]


def forward_returns(series: DataFrame, cfg: LabelingConfig = LabelingConfig()) -> DataFrame:
    """The label series with fwd_<horizon>, all null where one is missing or the close is 0. A series is a symbol's on an exchange."""
    key = series_key(series)
    w = W.partitionBy(*key).orderBy("timestamp")
    made = [F.when(F.col("close") != 0, F.lead("close", k).over(w) / F.col("close") - 1).alias(f"fwd_{h}") for h, k in cfg.horizons.items()]
    df = series.select(*key, "timestamp", "close", *made)
    whole = F.lit(True)
    for h in cfg.horizons:
        whole = whole & F.col(f"fwd_{h}").isNotNull()
    return df.select(*key, "timestamp", *[F.when(whole, F.col(f"fwd_{h}")).alias(f"fwd_{h}") for h in cfg.horizons])


#: Groups of at most so many events are ranked by a kernel each, larger ones by digits in this base, spread over tasks.
SMALL_GROUP, RADIX = 250_000, 8
_GROUP = ["pattern_type", "timeframe"]


def ranks(events: DataFrame, cfg: LabelingConfig = LabelingConfig(), small: int = SMALL_GROUP, group: list[str] | None = None) -> DataFrame:
    """Adds q_<horizon>, within groups of pattern_type and timeframe by default. events: the group, timestamp and fwd_<horizon>, which are null
    all together or not at all; events without returns have no rank and don't count for others. Both ways are exact and n log n."""
    by = group or _GROUP
    sized = events.withColumn("__size", F.count(F.lit(1)).over(W.partitionBy(*by)))
    few, many = (sized.where(c).drop("__size") for c in (F.col("__size") <= small, F.col("__size") > small))
    names = [f"fwd_{h}" for h in cfg.horizons]
    lags = [k * HOUR for k in cfg.horizons.values()]

    def run(group: pa.Table) -> pa.Table:
        has = np.flatnonzero(group.column(names[0]).is_valid().to_numpy())
        ts = group.column("timestamp").to_numpy()[has]
        for name, lag in zip(names, lags, strict=True):
            q, lacks = np.zeros(group.num_rows), np.ones(group.num_rows, bool)
            q[has], lacks[has] = ranked_before(ts, group.column(name).to_numpy(zero_copy_only=False)[has], lag), False
            group = group.append_column("q" + name.removeprefix("fwd"), pa.array(q, mask=lacks))
        return group

    ddl = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in events.schema.fields] + [f"q_{h} double" for h in cfg.horizons])
    lack = many.where(F.col(names[0]).isNull()).select("*", *[F.lit(None).cast("double").alias(f"q_{h}") for h in cfg.horizons])
    return few.groupBy(*by).applyInArrow(run, ddl).unionByName(ranks_by_digits(many.where(F.col(names[0]).isNotNull()), cfg, by)).unionByName(lack)


def ranked_before(ts: np.ndarray, values: np.ndarray, lag: int) -> np.ndarray:
    """Of each event the share of those at least `lag` before it whose value isn't larger; 0.5 without any.

    In the order of time, the events before a cutoff are a run from the first; it is cut into blocks of falling powers of two, and each
    block, which is sorted by value, is searched.
    """
    order = np.argsort(ts, kind="stable")
    before = np.searchsorted(ts[order], ts - lag, "right")
    rank = np.unique(values, return_inverse=True)[1].ravel().astype(np.int64)
    sorted_rank, n, count = rank[order], len(ts), np.zeros(len(ts), np.int64)
    for bit in range(n.bit_length()):
        asks = np.flatnonzero(before >> bit & 1)
        if len(asks):
            keys = np.sort((np.arange(n) >> bit) * n + sorted_rank)
            block = before[asks] >> (bit + 1) << 1
            count[asks] += np.searchsorted(keys, block * n + rank[asks], "right") - (block << bit)
    return np.where(before > 0, count / np.maximum(before, 1), 0.5)


def ranks_by_digits(events: DataFrame, cfg: LabelingConfig = LabelingConfig(), by: list[str] | None = None) -> DataFrame:
    """The same for groups of any size.

    Counting earlier events with no larger return is counting points below and left of others. Returns are numbered by size within their
    group; the numbers below r are those that share r's leading digits and have a smaller next one, for each digit of r. So each event
    becomes a row for each of its digits, and per leading digits a window in the order of time keeps how often each next digit has come.
    """
    group, hs = by or _GROUP, list(cfg.horizons)
    lag = F.expr("CASE h " + " ".join(f"WHEN {i} THEN {k * HOUR}L" for i, k in enumerate(cfg.horizons.values())) + " END")
    each = events.select(*group, "timestamp", *[f"fwd_{h}" for h in hs], F.posexplode(F.array(*[f"fwd_{h}" for h in hs])).alias("h", "v"))
    at = W.partitionBy(*group, "h")
    each = each.withColumn("r", F.dense_rank().over(at.orderBy("v")).cast("long"))
    each = each.withColumn("digits", F.ceil(F.log(float(RADIX), F.max("r").over(at) + 2) + 1e-9).cast("int"))
    place = f"CAST(pow({RADIX}, l) AS bigint)"
    rows = each.withColumn("l", F.explode(F.expr("sequence(0, digits - 1)")))
    points = rows.select(*group, "h", "l", F.expr(f"r DIV ({place} * {RADIX})").alias("node"), F.expr(f"CAST((r DIV {place}) % {RADIX} AS int)").alias("digit"), F.col("timestamp").alias("t"), F.lit(0).alias("asks"), *[F.lit(None).cast("double").alias(f"fwd_{h}") for h in hs], F.lit(None).cast("long").alias("timestamp"), F.lit(None).cast("boolean").alias("top"))
    asked = rows.dropDuplicates([*group, "timestamp", *[f"fwd_{h}" for h in hs], "h", "l"]).withColumn("r", F.col("r") + 1)
    asked = asked.select(*group, "h", "l", F.expr(f"r DIV ({place} * {RADIX})").alias("node"), F.expr(f"CAST((r DIV {place}) % {RADIX} AS int)").alias("digit"), (F.col("timestamp") - lag).alias("t"), F.lit(1).alias("asks"), *[f"fwd_{h}" for h in hs], "timestamp", (F.col("l") == F.col("digits") - 1).alias("top"))
    w = W.partitionBy(*group, "h", "l", "node").orderBy("t", "asks").rowsBetween(W.unboundedPreceding, 0)
    sums = [F.sum(F.when((F.col("asks") == 0) & (F.col("digit") == d), 1).otherwise(0)).over(w).alias(f"s{d}") for d in range(RADIX)]
    counted = points.unionByName(asked.where("digit > 0 OR top")).select("*", *sums).where("asks = 1")
    below = sum((F.when(F.col("digit") > d, F.col(f"s{d}")).otherwise(0) for d in range(RADIX)), F.lit(0))
    every = F.when(F.col("top"), sum((F.col(f"s{d}") for d in range(RADIX)), F.lit(0))).otherwise(0)
    keys = [*group, "timestamp", *[f"fwd_{h}" for h in hs]]
    total = counted.select(*keys, "h", below.alias("k"), every.alias("n")).groupBy(*keys).agg(
        *[F.sum(F.when(F.col("h") == i, F.col(c)).otherwise(0)).alias(f"__{c}_{h}") for i, h in enumerate(hs) for c in ("k", "n")]
    )
    df = events.join(total, keys)
    return df.select(*events.columns, *[F.when(F.col(f"__n_{h}") == 0, 0.5).otherwise(F.col(f"__k_{h}") / F.col(f"__n_{h}")).alias(f"q_{h}") for h in hs])


def label(instances: DataFrame, label_series: DataFrame, cfg: LabelingConfig = LabelingConfig(), group: list[str] | None = None) -> DataFrame:
    """Instances (symbol, timeframe, timestamp, pattern_type, ...) with returns, label_score and label; their ranks are taken within `group`.

    Where both tables have the column exchange, an instance looks at its exchange's candles only. What has no returns is Neutral with a score of 0.5.
    """
    names = [f"fwd_{h}" for h in cfg.horizons]
    got = next_at_or_after(instances, forward_returns(label_series, cfg), series_key(instances, label_series), names)
    score = F.coalesce(sum((F.col(f"q_{h}") * cfg.weights[h] for h in cfg.horizons), F.lit(0.0)), F.lit(0.5))
    named = F.when(F.col(names[0]).isNull(), "Neutral").when(F.col("label_score") >= cfg.good, "Good").when(F.col("label_score") <= cfg.bad, "Bad").otherwise("Neutral")
    return ranks(got, cfg, group=group).withColumn("label_score", score).withColumn("label", named).select(*got.columns, "label_score", "label")


def aligned(instances: DataFrame, primary: str, secondary: str, secondary_ms: int) -> DataFrame:
    """Primary instances with the number of secondary ones of the same pattern within two secondary bars, and the raised confidence.

    A band join by buckets of the band's width: each instance looks into its own bucket and both neighbours.
    """
    band, key = 2 * secondary_ms, [*series_key(instances), "pattern_type"]
    p = instances.where(F.col("timeframe") == primary).select("*", F.explode(F.expr(f"array(-1L, 0L, 1L)")).alias("__d")).withColumn("__b", F.floor(F.col("timestamp") / band) + F.col("__d"))
    s = instances.where(F.col("timeframe") == secondary).select(*key, F.col("timestamp").alias("__ts"), F.floor(F.col("timestamp") / band).alias("__b"))
    near = F.col("__ts").isNotNull() & (F.abs(F.col("__ts") - F.col("timestamp")) <= band)
    counted = p.join(s, [*key, "__b"], "left").groupBy(*instances.columns).agg(F.count_if(near).alias("matches"))
    return counted.withColumn("boosted", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("confidence") * (1 + 0.1 * F.col("matches")))))
