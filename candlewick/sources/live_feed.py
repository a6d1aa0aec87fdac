"""A streaming data source of closed candles from a candle service.

spark.readStream.format("live_candles").options(fetch="module:function", exchanges="first,fallback", symbols="A/U", timeframes="1h,4h", since="0")

An offset is, for each series, the time up to which its candles are safely closed: the open time after the newest candle that ended
`closed_safety_ms` (2500) before the clock. So a batch is a range of times for each series, and a batch that runs again after a restart asks
for the same ranges. A first batch, or one after a standstill, holds all that was missed since. Each batch also asks again for the last
`backfill` (3) candles before its range, so what a service delivers late comes once more; an upsert by key makes nothing of what it has.

Calls are tried again after doubling pauses (`tries`, `pause`), then the next exchange takes over. A candle that the service doesn't have yet
is waited for up to `patience` seconds; after that the batch goes on without it. `clock` gives milliseconds; it and
`fetch` are "module:function", or "file.py:function" with a file that the driver and the executors see.
"""

from __future__ import annotations

import time
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from candlewick.functions.scalars import tf_to_ms
from candlewick.sources.candles import SCHEMA
from candlewick.sources.paged import named, pages


class Range(InputPartition):
    def __init__(self, symbol: str, timeframe: str, start: int, stop: int):
        super().__init__((symbol, timeframe, start, stop))


class LiveReader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        self.options = dict(options)

    def _series(self) -> list[tuple[str, str]]:
        return [(s, t) for s in self.options["symbols"].split(",") for t in self.options["timeframes"].split(",")]

    def _since(self, timeframe: str) -> int:
        ms = tf_to_ms(timeframe)
        return -(-int(self.options.get("since", "0")) // ms) * ms

    def initialOffset(self) -> dict:
        return {f"{s}|{t}": self._since(t) for s, t in self._series()}

    def latestOffset(self) -> dict:
        now = named(self.options["clock"])() if "clock" in self.options else int(time.time() * 1000)
        closed = now - int(self.options.get("closed_safety_ms", "2500"))
        return {f"{s}|{t}": max(self._since(t), closed // tf_to_ms(t) * tf_to_ms(t)) for s, t in self._series()}

    def partitions(self, start: dict, end: dict) -> list[Range]:
        out = []
        for s, t in self._series():
            a, b = start.get(f"{s}|{t}", self._since(t)), end.get(f"{s}|{t}", 0)
            if b > a:
                out.append(Range(s, t, max(self._since(t), a - int(self.options.get("backfill", "3")) * tf_to_ms(t)), b))
        return out

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        symbol, timeframe, start, stop = partition.value
        last = stop - tf_to_ms(timeframe)
        until = time.time() + float(self.options.get("patience", "10"))
        rows: dict[int, tuple] = {}
        while True:
            rows |= {r[3]: r for r in pages(self.options, symbol, timeframe, max(rows, default=start - 1) + 1, stop)}
            if last in rows or time.time() >= until:
                break
            time.sleep(min(1.0, float(self.options.get("pause", "0.5"))))
        yield from (rows[k] for k in sorted(rows))

    def commit(self, end: dict) -> None:
        """The service keeps its candles: nothing to let go of."""


class LiveCandles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "live_candles"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema: object) -> LiveReader:
        return LiveReader(self.options)
