"""Training tables: balanced caps, sequence windows, time splits, scores of predictions, and standardisation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from candlewick.session import written

DAY = 86_400_000


def label_number(label: Column) -> Column:
    return F.when(label == "Good", 1).when(label == "Bad", 0)


def recent_balanced(rows: DataFrame, cap: int, label: str = "label") -> DataFrame:
    """Good and Bad rows; if they are more than `cap`, the newest cap / 2 of each label."""
    known = rows.where(F.col(label).isin("Good", "Bad"))
    if known.limit(cap + 1).count() <= cap:
        return known
    w = W.partitionBy(label).orderBy(F.desc("timestamp"), F.desc("pattern_type"), F.desc("symbol"))
    return known.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= cap // 2).drop("__r")


def sequences(rows: DataFrame, length: int, stride: int = 1, vector: str = "embedding", order: tuple[str, ...] = ("timestamp", "pattern_type")) -> DataFrame:
    """Windows of `length` rows of a (symbol, timeframe), every `stride`-th; the last row gives the target columns."""
    w = W.partitionBy("symbol", "timeframe").orderBy(*order)
    df = rows.select("*", F.row_number().over(w).alias("__n"), F.collect_list(vector).over(w.rowsBetween(-length + 1, 0)).alias("window"))
    return df.where((F.col("__n") >= length) & ((F.col("__n") - length) % stride == 0)).drop("__n", vector).withColumnRenamed("timestamp", "ts_end")


def recent_windows(windows: DataFrame, most: int) -> DataFrame:
    """The `most` newest windows (by ts_end, then series)."""
    return windows.orderBy(F.desc("ts_end"), "symbol", "timeframe", "pattern_type").limit(most)


def time_split(rows: DataFrame, ts: str = "timestamp", share: float = 0.8, embargo: int = DAY) -> DataFrame:
    """Adds split: val from the row at `share` on, train up to a day before its time, null between. The rows are written once, as the places
    of that row's day, of its time, and the split itself are each worked out from them."""
    rows, n = written(rows, "time-split"), F.count(F.lit(1))
    counted = rows.agg(n.alias("n")).select(F.least(F.greatest(F.floor(F.col("n") * share), F.lit(1)), F.col("n") - 1).alias("k"))
    before = lambda key: F.coalesce(F.sum("c").over(W.orderBy(key).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    # The day of the row first, from one count per day, then the time within that day: no window ever sees more than that.
    days = rows.groupBy(F.floor(F.col(ts) / DAY).alias("d")).agg(n.alias("c")).withColumn("b", before("d"))
    day = days.crossJoin(F.broadcast(counted)).where("b <= k AND k < b + c").select("d", (F.col("k") - F.col("b")).alias("k"))
    times = rows.select(F.col(ts).alias("t"), F.floor(F.col(ts) / DAY).alias("d")).join(F.broadcast(day), "d").groupBy("t", "k").agg(n.alias("c")).withColumn("b", before("t"))
    start = times.where("b <= k AND k < b + c").agg(F.min("t").alias("val_start"))  # a single row
    df = rows.crossJoin(F.broadcast(start))
    return df.withColumn("split", F.when(F.col(ts) >= F.col("val_start"), "val").when(F.col(ts) <= F.col("val_start") - embargo, "train")).drop("val_start")


def classification_scores(rows: DataFrame, label: str = "y", p: str = "p") -> DataFrame:
    """n, accuracy at 0.5 and the area under the ROC curve (null with one class), by average ranks of equal predictions."""
    by_p = rows.groupBy(p).agg(F.count(F.lit(1)).alias("n"), F.sum(label).alias("pos"), F.count_if((F.col(p) >= 0.5).cast("int") == F.col(label)).alias("right"))
    # Ranks start from counts of ten thousand bins; only predictions of one bin are ordered together.
    by_p = by_p.withColumn("bin", F.floor(F.col(p) * 10_000))
    bins = by_p.groupBy("bin").agg(F.sum("n").alias("c")).withColumn("b", F.coalesce(F.sum("c").over(W.orderBy("bin").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    before = F.col("b") + F.coalesce(F.sum("n").over(W.partitionBy("bin").orderBy(p).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    by_p = by_p.join(bins.select("bin", "b"), "bin")
    r = by_p.withColumn("rank", before + (F.col("n") + 1) / 2).agg(F.sum("n").alias("n"), F.sum("pos").alias("pos"), F.sum("right").alias("right"), F.sum(F.col("rank") * F.col("pos")).alias("ranks"))
    neg = F.col("n") - F.col("pos")
    return r.select("n", (F.col("right") / F.col("n")).alias("accuracy"), F.when((F.col("pos") > 0) & (neg > 0), (F.col("ranks") - F.col("pos") * (F.col("pos") + 1) / 2) / (F.col("pos") * neg)).alias("auc"))


def regression_scores(rows: DataFrame, y: str = "y", p: str = "p") -> DataFrame:
    err = F.col(y) - F.col(p)
    return rows.agg(F.count(F.lit(1)).alias("n"), F.avg(F.abs(err)).alias("mae"), (1 - F.sum(err * err) / (F.var_pop(y) * F.count(F.lit(1)))).alias("r2"))


def standardised(rows: DataFrame, columns: list[str]) -> DataFrame:
    """The columns less their mean, by their population deviation (1 where that is 0)."""
    aggs = [f(F.col(c)).alias(f"{n}_{c}") for c in columns for n, f in (("m", F.avg), ("s", F.stddev_pop))]
    df = rows.crossJoin(F.broadcast(rows.agg(*aggs)))  # a single row
    return df.select(*[c for c in rows.columns if c not in columns], *[((F.col(c) - F.col(f"m_{c}")) / F.when(F.col(f"s_{c}") > 0, F.col(f"s_{c}")).otherwise(1.0)).alias(c) for c in columns])
