"""A Spark data source for candle services that answer in pages.

spark.read.format("paged_candles").options(fetch="module:function", exchanges="first,fallback", symbols="A/U,B/U", timeframes="1h,4h", since="0")

fetch(exchange, symbol, timeframe, since_ms) returns rows [timestamp, open, high, low, close, volume] from that time on, in the order of
time. since_by (JSON, "symbol|timeframe" -> ms) gives a series a start of its own, such as its latest stored candle. Each series is a partition, so a lost executor costs one series. Pages are asked for until one brings nothing newer; a call that
fails is tried again after doubling pauses, then the next exchange takes over from where the series stands.
"""

from __future__ import annotations

import importlib
import importlib.util
import json
import time
from collections.abc import Callable, Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from candlewick.sources.candles import SCHEMA


class Series(InputPartition):
    def __init__(self, symbol: str, timeframe: str):
        super().__init__((symbol, timeframe))


def named(path: str) -> Callable:
    """The function of "module:function" or "file.py:function"."""
    module, _, name = path.rpartition(":")
    if not module.endswith(".py"):
        return getattr(importlib.import_module(module), name)
    spec = importlib.util.spec_from_file_location(module.rsplit("/", 1)[-1].removesuffix(".py"), module)
    made = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(made)
    return getattr(made, name)


def pages(options: dict[str, str], symbol: str, timeframe: str, since: int, stop: int | None = None) -> Iterator[tuple]:
    """A series' candles from `since` on (before `stop`), page by page."""
    fetch = named(options["fetch"])
    tries, pause, failed = int(options.get("tries", "4")), float(options.get("pause", "0.5")), None
    for exchange in options["exchanges"].split(","):
        attempt = 0
        while attempt < tries:
            try:
                page = fetch(exchange, symbol, timeframe, since)
            except Exception as e:
                failed, attempt = e, attempt + 1
                time.sleep(pause * 2 ** (attempt - 1))
                continue
            attempt = 0
            new = [r for r in page if int(r[0]) >= since]
            for r in new:
                if stop is None or int(r[0]) < stop:
                    yield exchange, symbol, timeframe, int(r[0]), *(float(x) for x in r[1:6])
            if not new or (stop is not None and max(int(r[0]) for r in new) >= stop - 1):  # a stalled page ends the series
                return
            since = max(int(r[0]) for r in new) + 1
    raise RuntimeError(f"{symbol} {timeframe}: no exchange answered") from failed


class PagedReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.options = dict(options)

    def partitions(self) -> list[Series]:
        return [Series(s, t) for s in self.options["symbols"].split(",") for t in self.options["timeframes"].split(",")]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        symbol, timeframe = partition.value
        own = json.loads(self.options.get("since_by", "{}"))
        yield from pages(self.options, symbol, timeframe, int(own.get(f"{symbol}|{timeframe}", self.options.get("since", "0"))))


class PagedCandles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "paged_candles"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: object) -> PagedReader:
        return PagedReader(self.options)
