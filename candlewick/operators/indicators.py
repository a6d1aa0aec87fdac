"""Rolling indicators over candle series, as window expressions on one shuffle by series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from candlewick.operators import slices
from candlewick.session import written
from candlewick.sources.candles import KEYS, series_window

ATR = 14


def true_range(w: object) -> Column:
    before = F.coalesce(F.lag("close").over(w), F.col("close"))
    return F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before))


def regime(share: Column) -> Column:
    return F.when(share < 0.01, "low").when(share < 0.03, "mid").otherwise("high")


def with_atr(candles: DataFrame, length: int = ATR, short: int | None = None, rows: int = slices.SLICE) -> DataFrame:
    """Adds idx (from 0), n, tr, and atr: the mean of the last `length` true ranges from row `length` on, its first value before that,
    and the mean of all in shorter series. With `short`, series are counted, and if one has more rows than that, they are cut into slices."""
    if slices.is_long(candles, KEYS[:3], short):
        return _atr_in_slices(candles, length, rows)
    w = series_window()
    whole = w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    df = candles.select("*", (F.row_number().over(w) - 1).alias("idx"), F.count(F.lit(1)).over(whole).alias("n"), true_range(w).alias("tr"))
    df = df.withColumn("rolled", F.when(F.col("idx") >= length, F.avg("tr").over(w.rowsBetween(-length + 1, 0))))
    first = F.max(F.when(F.col("idx") == length, F.col("rolled"))).over(whole)
    return df.withColumn("atr", F.coalesce("rolled", first, F.avg("tr").over(whole))).drop("rolled")


def _atr_in_slices(candles: DataFrame, length: int, rows: int) -> DataFrame:
    """The same: each slice gets the last `length` rows before it, their number, and the numbers of the whole series."""
    key = KEYS[:3]
    df = slices.sliced(candles, key, ["timestamp"], rows)
    tail = F.slice(F.sort_array(F.collect_list(F.struct("timestamp", "high", "low", "close")), asc=False), 1, length)
    # Slices that are shorter than the window hand on what they got, so tails are put together over as many slices as that takes.
    each = written(df.groupBy(*key, "__slice").agg(F.count(F.lit(1)).alias("c"), tail.alias("t")), "atr-tails")
    seen = W.partitionBy(*key).orderBy("__slice")
    put = F.slice(F.sort_array(F.flatten(F.collect_list("t").over(seen.rowsBetween(-length, -1))), asc=False), 1, length)
    each = written(each.select(*key, "__slice", F.coalesce(F.sum("c").over(seen.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"), F.sum("c").over(W.partitionBy(*key)).alias("n"), put.alias("t")), "atr-carries")
    lent = each.select(*key, "__slice", "before", "n", F.inline("t")).withColumns({"__own": F.lit(0), "open": F.lit(None).cast("double"), "volume": F.lit(None).cast("double")})
    own = df.join(each.drop("t"), [*key, "__slice"]).withColumn("__own", F.lit(1))
    extra = {c: F.lit(None).cast(t) for c, t in own.dtypes if c not in lent.columns}
    both = own.unionByName(lent.withColumns(extra).select(*own.columns))
    w = slices.within(key).orderBy("timestamp")
    behind = F.sum(F.col("__own")).over(w.rowsBetween(W.unboundedPreceding, 0))
    both = both.withColumn("idx", F.col("before") + behind - 1).withColumn("__lag", F.lag("close").over(w))
    before = F.coalesce("__lag", F.col("close"))
    both = both.withColumn("tr", F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before)))
    # The oldest lent row has no row before it, but no own row's window of `length` ranges reaches it.
    both = both.withColumn("rolled", F.when(F.col("idx") >= length, F.avg("tr").over(w.rowsBetween(-length + 1, 0)))).where("__own = 1")
    both = written(both.select(*candles.columns, "idx", "n", "tr", "rolled"), "atr-rows")
    whole = written(both.groupBy(*key).agg(F.max(F.when(F.col("idx") == length, F.col("rolled"))).alias("__first"), F.avg("tr").alias("__mean")), "atr-series")
    return both.join(whole, key).withColumn("atr", F.coalesce("rolled", "__first", "__mean")).select(*candles.columns, "idx", "n", "tr", "atr")


def at_event(candles: DataFrame, length: int = ATR, segment: int = 51) -> DataFrame:
    """Adds the volatility and volume context that an event at each candle has.

    atr_event: mean of the last true ranges if 15 rows are at hand in the segment, else of all of it. Volume: mean and population
    deviation of the rows before in the segment (a single row: itself; two rows: deviation of both), and the z-score.
    """
    w = series_window()
    df = candles.select("*", (F.row_number().over(w) - 1).alias("idx"), true_range(w).alias("tr"))
    seg, before = w.rowsBetween(-segment + 1, 0), w.rowsBetween(-segment + 1, -1)
    df = df.select("*", F.when(F.col("idx") >= length, F.avg("tr").over(w.rowsBetween(-length + 1, 0))).otherwise(F.avg("tr").over(seg)).alias("atr_event"))
    df = df.withColumn("atr_pct", F.when(F.col("close") != 0, F.col("atr_event") / F.col("close")).otherwise(F.lit(0.0)))
    mean = F.when(F.col("idx") == 0, F.col("volume")).otherwise(F.avg("volume").over(before))
    std = F.when(F.col("idx") == 0, F.lit(0.0)).when(F.col("idx") == 1, F.stddev_pop("volume").over(seg)).otherwise(F.stddev_pop("volume").over(before))
    df = df.select("*", regime(F.col("atr_pct")).alias("regime"), mean.alias("vol_mean"), std.alias("vol_std"))
    return df.withColumn("vol_z", (F.col("volume") - F.col("vol_mean")) / (F.col("vol_std") + 1e-12))


def trend_slope(lookback: int = 10) -> Column:
    """Least-squares slope of up to `lookback` closes before the candle (needs idx); 0 with fewer than two."""
    w = series_window().rowsBetween(-lookback, -1)
    return F.when(F.count(F.lit(1)).over(w) < 2, 0.0).otherwise(F.coalesce(F.regr_slope("close", "idx").over(w), F.lit(0.0)))


def market_features(candles: DataFrame, lookback: int = 30) -> DataFrame:
    """Adds returns over 1, 3 and 5 rows, the close against its rolling mean, and the volume against its own (0 where rows are missing)."""
    w = series_window()
    rolled = w.rowsBetween(-lookback + 1, 0)
    lagged = [F.coalesce(F.col("close") / F.lag("close", k).over(w) - 1, F.lit(0.0)).alias(f"ret_{k}") for k in (1, 3, 5)]
    return candles.select("*", *lagged, (F.col("close") / F.avg("close").over(rolled) - 1).alias("sma_rel"), (F.col("volume") / (F.avg("volume").over(rolled) + 1e-12)).alias("vol_rel"))


def drawdowns(curve: DataFrame, key: str, order: str, equity: str = "equity", short: int | None = None, length: int = slices.SLICE) -> DataFrame:
    """Adds the share lost since the running peak. With `short`, keys are counted, and if one has more rows
    than that, they are cut into slices that go on from the peak before."""
    if slices.is_long(curve, [key], short):
        curve = slices.carried(slices.sliced(curve, [key], [order], length), [key], {"__peak": F.max(equity)}, {"__before": F.max("__peak")})
        peak = F.greatest(F.max(equity).over(slices.within([key]).orderBy(order).rowsBetween(W.unboundedPreceding, 0)), F.col("__before"))
    else:
        peak = F.max(equity).over(W.partitionBy(key).orderBy(order).rowsBetween(W.unboundedPreceding, 0))
    return curve.withColumn("drawdown", (peak - F.col(equity)) / F.greatest(peak, F.lit(1e-12))).drop("__slice", "__before")
