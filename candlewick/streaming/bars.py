"""Closed candles of several timeframes from one stream of base candles, by keyed state and event-time timers.

The state of a series holds its base candles that some open larger candle still needs, by time, each with the sequence it was written with.
A base candle that arrives again replaces what is held if its sequence isn't lower: the last write wins. A timer stands at the end of every
larger candle; once the watermark has passed it, the candle is emitted with the number of base candles that it lacks, and what no open candle
needs is dropped. A hole between two closed base candles is emitted as a row of its own, once, when the candle after it is closed. What arrives
behind the watermark is dropped by Spark, as its candles are closed.

Rows: kind ("candle" or "gap"), timeframe, timestamp, open to volume (null for gaps), missing (base candles that lack), until (end of the row's time).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from candlewick.functions.scalars import tf_to_ms

SCHEMA = "exchange string, symbol string, kind string, timeframe string, timestamp long, open double, high double, low double, close double, volume double, missing long, until long"
_NUMBERS = ["open", "high", "low", "close", "volume"]


class Bars(StatefulProcessor):
    def __init__(self, base: str, timeframes: list[str]):
        self.base, self.frames = tf_to_ms(base), {t: tf_to_ms(t) for t in timeframes}
        if bad := [t for t, ms in self.frames.items() if ms % self.base]:
            raise ValueError(f"{bad} aren't multiples of {base}")
        self.longest = max(self.frames.values())

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getMapState("held", "timestamp long", "seq long, open double, high double, low double, close double, volume double")
        self.closed = handle.getValueState("closed", "timestamp long")  # the newest closed base candle

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        best: dict[int, tuple] = {}
        for part in rows:
            for r in part[["timestamp", "seq", *_NUMBERS]].itertuples(index=False, name=None):
                at, row = int(r[0]), (int(r[1]), *(float(x) for x in r[2:]))
                if at not in best or row >= best[at]:
                    best[at] = row
        for at, row in best.items():
            if not self.held.containsKey((at,)) or row >= tuple(self.held.getValue((at,))):
                self.held.updateValue((at,), row)
            for ms in {self.base, *self.frames.values()}:
                self.handle.registerTimer(at // ms * ms + ms)
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:
        end, out = expiredTimerInfo.getExpiryTimeInMs(), []
        bars = {int(k[0]): tuple(v) for k, v in self.held.iterator()}
        at = end - self.base
        if at in bars:
            before = int(self.closed.get()[0]) if self.closed.exists() else None
            if before is not None and at > before + self.base:
                out.append(("gap", None, before + self.base, *[None] * 5, (at - before) // self.base - 1, at))
            if before is None or at > before:
                self.closed.update((at,))
        for name, ms in self.frames.items():
            inside = [bars[t] for t in sorted(bars) if end - ms <= t < end] if end % ms == 0 else []
            if inside:
                numbers = (inside[0][1], max(b[2] for b in inside), min(b[3] for b in inside), inside[-1][4], sum(b[5] for b in inside))
                out.append(("candle", name, end - ms, *numbers, ms // self.base - len(inside), end))
        for t in bars:
            if all(t // ms * ms + ms <= end for ms in self.frames.values()):
                self.held.removeKey((t,))
        if out:
            yield pd.DataFrame([(*key, *r) for r in out], columns=[c.split()[0] for c in SCHEMA.split(", ")]).astype({"missing": "int64", "until": "int64", "timestamp": "int64"})

    def close(self) -> None:
        pass


def closed_bars(stream: DataFrame, base: str, timeframes: list[str], late: str = "0 seconds") -> DataFrame:
    """The rows of this module for a stream of base candles (exchange, symbol, timestamp, open to volume, ingest_seq); `late` is how long a
    candle may come after newer ones. Needs the RocksDB state store."""
    rows = stream.select("exchange", "symbol", "timestamp", F.coalesce("ingest_seq", F.lit(0)).alias("seq"), *_NUMBERS, F.timestamp_millis("timestamp").alias("at")).withWatermark("at", late)
    return rows.groupBy("exchange", "symbol").transformWithStateInPandas(Bars(base, timeframes), SCHEMA, "Append", "EventTime")


def batch_bars(rows: DataFrame, base: str, timeframes: list[str], watermark: int) -> DataFrame:
    """The same of a table: what is closed by `watermark` (milliseconds)."""
    ms, key = tf_to_ms(base), ["exchange", "symbol"]
    last = rows.groupBy(*key, "timestamp").agg(F.max(F.struct(F.coalesce("ingest_seq", F.lit(0)), *_NUMBERS)).alias("r")).select(*key, "timestamp", "r.*")
    out = None
    for name in timeframes:
        span = tf_to_ms(name)
        each = last.withColumn("b", F.floor(F.col("timestamp") / span) * span).where(F.col("b") + span <= watermark).groupBy(*key, "b").agg(
            F.min_by("open", "timestamp").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "timestamp").alias("close"), F.sum("volume").alias("volume"), F.count(F.lit(1)).alias("n")
        )
        each = each.select(*key, F.lit("candle").alias("kind"), F.lit(name).alias("timeframe"), F.col("b").alias("timestamp"), *_NUMBERS, (span // ms - F.col("n")).alias("missing"), (F.col("b") + span).alias("until"))
        out = each if out is None else out.unionByName(each)
    before = F.lag("timestamp").over(W.partitionBy(*key).orderBy("timestamp"))
    holes = last.where(F.col("timestamp") + ms <= watermark).withColumn("p", before).where(F.col("timestamp") > F.col("p") + ms)
    holes = holes.select(*key, F.lit("gap").alias("kind"), F.lit(None).cast("string").alias("timeframe"), (F.col("p") + ms).alias("timestamp"), *[F.lit(None).cast("double").alias(c) for c in _NUMBERS], F.expr(f"(timestamp - p) DIV {ms} - 1").alias("missing"), F.col("timestamp").alias("until"))
    return out.unionByName(holes)
