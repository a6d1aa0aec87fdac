"""Scalar helpers and column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

UNIT_MS = {"m": 60_000, "h": 3_600_000, "d": 86_400_000, "w": 604_800_000}


def tf_to_ms(timeframe: str) -> int:
    """Milliseconds of a timeframe such as 5m, 4h or 1d."""
    m = re.fullmatch(r"\s*(\d+)([mhdwMHDW])\s*", timeframe)
    if not m:
        raise ValueError(f"unknown timeframe: {timeframe!r}")
    return int(m[1]) * UNIT_MS[m[2].lower()]


def tf_to_ms_column(timeframe: Column) -> Column:
    unit = F.lower(F.regexp_extract(timeframe, r"([A-Za-z])\s*$", 1))
    n = F.regexp_extract(timeframe, r"(\d+)", 1).cast("long")
    return n * F.when(unit == "m", UNIT_MS["m"]).when(unit == "h", UNIT_MS["h"]).when(unit == "d", UNIT_MS["d"]).when(unit == "w", UNIT_MS["w"])


def horizon_steps(horizon: str, execution: str) -> int:
    """Bars of `execution` in a horizon, at least one; halves round to even."""
    return max(1, round(tf_to_ms(horizon) / tf_to_ms(execution)))


def iso_utc(ms: Column) -> Column:
    return F.concat(F.date_format(F.timestamp_millis(ms), "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z"))


def record_id(*columns: str) -> Column:
    return F.concat_ws("|", *[F.col(c).cast("string") for c in columns])


def file_symbol(symbol: Column) -> Column:
    return F.replace(symbol, F.lit("/"), F.lit("_"))


def md5_mod24(text: str) -> str:
    """SQL of md5(text) as a big-endian integer, modulo 24: 16^k is 16 modulo 24 for every k from 1 on."""
    return f"""CAST(aggregate(sequence(1, 32), 0L, (a, k) -> (16 * a + CAST(conv(substring(md5({text}), k, 1), 16, 10) AS bigint)) % 24) AS int)"""


def multi_hot(pattern: str, dims: int = 24, hashes: int = 6) -> Column:
    """dims numbers, 1 at the places that md5 of "pattern|i" gives for i below `hashes`."""
    places = "array(" + ", ".join(md5_mod24(f"concat({pattern}, '|{i}')") for i in range(hashes)) + ")"
    return F.expr(f"transform(array({places}), p -> transform(sequence(0, {dims - 1}), k -> IF(array_contains(p, k), 1D, 0D)))[0]")


def resampled(values: str, n: int) -> str:
    """SQL of a linear resampling of an array to n points; zeros if it is empty, itself if it has n."""
    at = f"(i * (size({values}) - 1) / {n - 1}D)"
    low = f"CAST(floor({at}) AS int)"
    return f"""CASE WHEN size({values}) = 0 THEN transform(sequence(1, {n}), i -> 0D) WHEN size({values}) = {n} THEN {values}
        ELSE transform(sequence(0, {n - 1}), i -> {values}[{low}] + ({at} - {low}) * ({values}[least({low} + 1, size({values}) - 1)] - {values}[{low}])) END"""


def slope_mean(y: str) -> str:
    return f"IF(size({y}) < 3, 0D, ({y}[greatest(size({y}) - 1, 0)] - {y}[0]) / greatest(size({y}) - 1, 1))"


def curvature_mean(y: str) -> str:
    return f"IF(size({y}) < 3, 0D, aggregate(sequence(1, greatest(size({y}) - 2, 1)), 0D, (acc, ix) -> acc + abs({y}[ix + 1] - 2 * {y}[ix] + {y}[ix - 1])) / greatest(size({y}) - 2, 1))"


def dtw(a: str, b: str) -> str:
    """SQL of the dynamic time warping distance of two arrays with absolute costs; infinite if one is empty. Row by row."""
    first = f"transform(sequence(0, size({b})), j -> IF(j = 0, 0D, double('Infinity')))"
    cell = f"abs(x - {b}[j]) + least(prev[j], prev[j + 1], r[j])"
    row = f"aggregate(sequence(0, size({b}) - 1), array(double('Infinity')), (r, j) -> array_append(r, {cell}))"
    return f"IF(size({a}) = 0 OR size({b}) = 0, double('Infinity'), element_at(aggregate({a}, {first}, (prev, x) -> {row}), -1))"


def cosine(a: str, b: str) -> str:
    dot = lambda x, y: f"aggregate(zip_with({x}, {y}, (u, v) -> CAST(u AS double) * v), 0D, (s, z) -> s + z)"
    return f"try_divide({dot(a, b)}, sqrt({dot(a, a)}) * sqrt({dot(b, b)}) + 1e-12D)"
