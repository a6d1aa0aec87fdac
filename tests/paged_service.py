"""A candle service for the tests: pages of three, the first exchange breaks down half-way."""

import random


def fetch(exchange, symbol, timeframe, since):
    if exchange == "first" and symbol == "B/U" and since > 4:
        raise TimeoutError
    if exchange == "none":
        raise OSError
    return [[t, "1", "2", "0.5", str(t), "7"] for t in range(10) if t >= since][:3]


def walk(exchange, symbol, timeframe, since):
    """1200 hourly candles of a random walk, 300 of four hours; 500 a page."""
    rng = random.Random(7)
    price, rows, step = 100.0, [], {"1h": 3_600_000, "4h": 14_400_000}[timeframe]
    for i in range({"1h": 1200, "4h": 300}[timeframe]):
        close = price * (1 + rng.gauss(0, 0.01))
        rows.append([i * step, price, max(price, close) * 1.001, min(price, close) * 0.999, close, 10 + rng.random()])
        price = close
    return [r for r in rows if r[0] >= since][:500]
