"""Candle tables: derivation from raw rows, upsert, scans, decoding and checks.

A candle is (exchange, symbol, timeframe, timestamp, open, high, low, close, volume); timestamp is the open time in milliseconds. The four
keys are unique. Stored candles are Parquet, partitioned by exchange, symbol and timeframe.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from candlewick.functions.scalars import file_symbol, tf_to_ms, tf_to_ms_column
from candlewick.session import written

KEYS = ["exchange", "symbol", "timeframe", "timestamp"]
COLUMNS = [*KEYS, "open", "high", "low", "close", "volume"]
SCHEMA = "exchange string, symbol string, timeframe string, timestamp long, open double, high double, low double, close double, volume double"


def bucketed(rows: DataFrame, symbol: Column, at_ms: Column, price: Column, volume: Column, order: Column, timeframe: str, exchange: str = "local") -> DataFrame:
    """Candles of raw rows; `order` tells the first and last row of a bucket. One aggregation, combined before the shuffle."""
    ms = tf_to_ms(timeframe)
    keyed = rows.select(symbol.alias("symbol"), (F.floor(at_ms / ms) * ms).cast("long").alias("timestamp"), price.cast("double").alias("p"), volume.alias("v"), order.alias("o"))
    made = keyed.groupBy("symbol", "timestamp").agg(F.min_by("p", "o").alias("open"), F.max("p").alias("high"), F.min("p").alias("low"), F.max_by("p", "o").alias("close"), F.sum("v").cast("double").alias("volume"))
    return made.select(F.lit(exchange).alias("exchange"), "symbol", F.lit(timeframe).alias("timeframe"), "timestamp", "open", "high", "low", "close", "volume")


def from_events(spark: SparkSession, sf_dir: str, timeframe: str, by_type: bool = True) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    symbol = F.col("event_type") if by_type else F.lit("ALL")
    return bucketed(e, symbol, F.unix_millis(F.col("ts").cast("timestamp")), F.col("value"), F.lit(1.0), F.struct("ts", "event_id"), timeframe)


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    symbol = F.concat("l_returnflag", F.lit("/"), "l_linestatus")
    order = F.struct("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    return bucketed(li, symbol, F.unix_millis(F.col("l_shipdate").cast("timestamp")), F.col("l_extendedprice"), F.col("l_quantity"), order, "1d")


def decoded(rows: DataFrame, payload: str, exchange: str, symbol: str, timeframe: str) -> DataFrame:
    """Candles of JSON arrays [timestamp, open, high, low, close, volume] whose members may be strings."""
    a = F.from_json(payload, "array<string>")
    return rows.select(F.lit(exchange).alias("exchange"), F.lit(symbol).alias("symbol"), F.lit(timeframe).alias("timeframe"), a[0].cast("long").alias("timestamp"), *[a[i].cast("double").alias(c) for i, c in enumerate(COLUMNS[4:], 1)])


def validated(candles: DataFrame, strict: bool = False) -> DataFrame:
    """Candles in the order of time; strict: without those whose low or high doesn't bound open and close."""
    df = candles.where("low <= least(open, close) AND high >= greatest(open, close)") if strict else candles
    return df.orderBy("exchange", "symbol", "timeframe", "timestamp")


def upserted(stored: DataFrame, new: DataFrame, sequence: str = "ingest_seq", keep: bool = False) -> DataFrame:
    """Both tables' candles, the one with the highest sequence per key; of equal ones the new one. keep: with its sequence."""
    both = stored.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)), allowMissingColumns=True)
    at = F.coalesce(F.col(sequence), F.lit(-1)) if sequence in both.columns else F.lit(-1)
    rank = F.struct(at.alias("q"), "__new", *COLUMNS[4:])
    kept = both.groupBy(*KEYS).agg(F.max(rank).alias("r"))
    return kept.select(*KEYS, *[F.col(f"r.{c}").alias(c) for c in COLUMNS[4:]], *([F.col("r.q").cast("long").alias(sequence)] if keep else []))


def store(candles: DataFrame, path: str) -> None:
    """Writes whole partitions; partitions that aren't in `candles` stay."""
    out = candles.withColumn("symbol_dir", file_symbol(F.col("symbol")))
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "snappy").partitionBy("exchange", "symbol_dir", "timeframe").parquet(path)


def stored(spark: SparkSession, path: str) -> DataFrame | None:
    """All stored candles; None if there are none yet."""
    try:
        return spark.read.parquet(path).select(*COLUMNS)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return None


def merge(spark: SparkSession, path: str, new: DataFrame) -> None:
    """Upserts new candles into the stored ones. Only series that get candles are rewritten, from a table written beside them first."""
    fresh, old = written(new, "candles-new"), stored(spark, path)
    if old is not None:
        old = old.join(fresh.select(*KEYS[:3]).distinct(), KEYS[:3], "left_semi")
        fresh = written(upserted(old, fresh), "candles-merged")
    if fresh.limit(1).count():
        store(fresh, path)


def scan(spark: SparkSession, path: str, exchange: str, symbol: str, timeframe: str, start: int | None = None, end: int | None = None) -> DataFrame:
    """One series; the keys prune partitions and the range reaches the scan. Symbols that share a folder (A/B and A_B) are told apart."""
    df = spark.read.parquet(path).where((F.col("exchange") == exchange) & (F.col("symbol_dir") == symbol.replace("/", "_")) & (F.col("timeframe") == timeframe) & (F.col("symbol") == symbol))
    df = df if start is None else df.where(F.col("timestamp") >= start)
    df = df if end is None else df.where(F.col("timestamp") <= end)
    return df.select(*COLUMNS).orderBy("timestamp")


def latest(candles: DataFrame) -> DataFrame:
    return candles.groupBy("exchange", "symbol", "timeframe").agg(F.max("timestamp").alias("latest"), F.count(F.lit(1)).alias("n"))


def exists(candles: DataFrame, exchange: str, symbol: str, timeframe: str) -> bool:
    return bool(candles.where((F.col("exchange") == exchange) & (F.col("symbol") == symbol) & (F.col("timeframe") == timeframe)).limit(1).count())


def pick_exchange(candles: DataFrame, required: list[str], priority: list[str]) -> DataFrame:
    """Per symbol the first exchange of `priority` that has all required timeframes, else the first one that has any."""
    place = F.array_position(F.lit(priority), F.col("exchange"))
    have = candles.where(F.col("exchange").isin(priority)).groupBy("symbol", "exchange").agg(F.count_distinct(F.when(F.col("timeframe").isin(required), F.col("timeframe"))).alias("n"))
    return have.groupBy("symbol").agg(F.min_by("exchange", F.struct(F.col("n") < len(required), place)).alias("exchange"))


def of_one_exchange(candles: DataFrame, required: list[str], priority: list[str] | None = None) -> DataFrame:
    """The candles of each symbol's chosen exchange (as pick_exchange; by default exchanges are tried in the order of their names), so that what
    is built from them never mixes two exchanges' prices."""
    names = priority if priority is not None else sorted(r.exchange for r in candles.select("exchange").distinct().collect())
    chosen = written(pick_exchange(candles, required, names), "chosen-exchanges")  # a row per symbol
    return candles.join(chosen, ["symbol", "exchange"], "left_semi")


def closed(candles: DataFrame, now_ms: int) -> DataFrame:
    """Newest closed candle of every series: that has ended by now, else the one before it."""
    ms = tf_to_ms_column(F.col("timeframe"))
    newest = candles.groupBy("exchange", "symbol", "timeframe").agg(F.max("timestamp").alias("ts"))
    return newest.select("exchange", "symbol", "timeframe", F.when(F.col("ts") <= now_ms - ms, F.col("ts")).otherwise(F.col("ts") - ms).alias("closed_ts"))


def series_window() -> W:
    return W.partitionBy("exchange", "symbol", "timeframe").orderBy("timestamp")
