"""Chart structure patterns over pivots.

A series enters as one row of arrays of its last 5000 candles, a bound of the semantics; pivots come from an Arrow kernel on such rows
(prominence needs a scan that window frames can't express), everything after it is expressions. Pairs and triples are those of at most
30 pivots a side.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from candlewick.functions.scalars import curvature_mean, slope_mean
from candlewick.operators.candlestick import number_map
from candlewick.operators.indicators import ATR, true_range
from candlewick.session import written
from candlewick.sources.candles import series_window

ROWS, LEAST, PIVOTS, DISTANCE = 5000, 200, 30, 10
KEYS = ["exchange", "symbol", "timeframe"]


def peaks(x: np.ndarray, distance: int, prominence: float) -> np.ndarray:
    """Places of local maxima (of a flat top its middle), thinned by distance from the highest down, then by prominence.

    Of equal heights the later one goes first.
    """
    change = np.flatnonzero(np.diff(x) != 0)
    starts, stops = np.concatenate([[0], change + 1]), np.concatenate([change, [len(x) - 1]])
    v = x[starts]
    top = np.flatnonzero((v[1:-1] > v[:-2]) & (v[1:-1] > v[2:])) + 1
    at = (starts[top] + stops[top]) // 2
    keep = np.ones(len(at), bool)
    for i in np.lexsort((at, x[at]))[::-1]:
        if keep[i]:
            near = np.abs(at - at[i]) < distance
            near[i] = False
            keep &= ~near
    out = []
    for p in at[keep]:
        higher = np.flatnonzero(x > x[p])
        left = higher[higher < p].max(initial=-1) + 1
        right = higher[higher > p].min(initial=len(x))
        if x[p] - max(x[left : p + 1].min(), x[p:right].min()) >= prominence:
            out.append(p)
    return np.array(out, int)


def segments(candles: DataFrame, rows: int = ROWS, least: int = LEAST) -> DataFrame:
    """One row per series of at least `least` candles: arrays ts, o, h, l, c, v of the last `rows`, and atr, the mean of the last true ranges."""
    w = series_window()
    whole = w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    df = candles.select("*", (F.row_number().over(w) - 1).alias("i"), F.count(F.lit(1)).over(whole).alias("total")).where((F.col("total") >= least) & (F.col("i") >= F.col("total") - rows))
    df = df.withColumn("tr", true_range(w))
    packed = df.groupBy(*KEYS).agg(F.sort_array(F.collect_list(F.struct("i", "timestamp", "open", "high", "low", "close", "volume", "tr"))).alias("b"))
    arrays = [F.expr(f"transform(b, x -> x.{k})").alias(a) for a, k in (("ts", "timestamp"), ("o", "open"), ("h", "high"), ("l", "low"), ("c", "close"), ("v", "volume"))]
    return packed.select(*KEYS, F.size("b").alias("n"), *arrays, F.expr(f"aggregate(slice(b, greatest(size(b) - {ATR - 1}, 1), {ATR}), 0D, (a, x) -> a + x.tr) / least(size(b), {ATR})").alias("atr"))


def with_pivots(series: DataFrame) -> DataFrame:
    """Adds hi and lo, arrays of (i, p), cut to the last 30 highs, then to the last 30 lows."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            hi, lo = [], []
            for h, low, atr in zip(f["h"], f["l"], f["atr"], strict=True):
                a, b = (peaks(np.asarray(x, float), DISTANCE, max(1e-12, 0.15 * atr)) for x in (h, [-v for v in low]))
                for side in (0, 1):
                    mine = (a, b)[side]
                    if len(mine) > PIVOTS:
                        a, b = a[a >= mine[-PIVOTS]], b[b >= mine[-PIVOTS]]
                hi.append([{"i": int(i), "p": float(h[i])} for i in a])
                lo.append([{"i": int(i), "p": float(low[i])} for i in b])
            yield f.assign(hi=hi, lo=lo)

    pivots = "array<struct<i:int,p:double>>"
    ddl = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in series.schema.fields)
    return series.mapInPandas(run, f"{ddl}, hi {pivots}, lo {pivots}")


def _neck(side: str, a: str, b: str) -> str:
    """Neckline between places a and b: the highest low pivot within (tops), the lowest high pivot (bottoms); raw extreme without any."""
    other, best, raw, line = ("lo", "array_max", "array_min", "l") if side == "top" else ("hi", "array_min", "array_max", "h")
    return f"coalesce({best}(transform(filter({other}, q -> q.i > {a} AND q.i < {b}), q -> q.p)), {raw}(slice({line}, {a} + 1, {b} - {a} + 1)))"


def _curve(start: str, stop: str) -> str:
    """(slope, curvature) of the closes of that range over the first one."""
    seg = f"slice(c, ({start}) + 1, ({stop}) - ({start}) + 1)"
    y = f"transform({seg}, z -> z / IF(c[{start}] = 0, 1D, c[{start}]))"
    return f"transform(array({y}), y -> struct({slope_mean('y')} AS slope_mean, {curvature_mean('y')} AS curvature_mean))[0]"


#: features and geometry are maps of numbers, lists a map of lists of numbers; neckline and the curve's numbers are also in geometry.
_COLUMNS = [*KEYS, "timestamp", "pattern_type", "direction", "confidence", "neckline", "slope_mean", "curvature_mean", "features", "lists", "geometry"]
_NO_LISTS = "CAST(map() AS map<string,array<double>>)"


def _lists(pairs: dict[str, str]) -> str:
    return "CAST(map({}) AS map<string,array<double>>)".format(", ".join(f"'{k}', transform({v}, z -> CAST(z AS double))" for k, v in pairs.items()))


def _emit(df: DataFrame, name: str, side: str, first: str, last: str, confidence: str, neck: str, features: dict[str, str], lists: dict[str, str], more: dict[str, str]) -> DataFrame:
    """Rows whose close after `last` breaks the neckline."""
    margin = "0.02D * atr"
    broken = f"c[{last} + 1] < neck - {margin}" if side == "top" else f"c[{last} + 1] > neck + {margin}"
    df = df.where(f"{last} + 1 < n").withColumn("neck", F.expr(neck)).where(broken).withColumn("cv", F.expr(_curve(first, f"least({last} + 10, n - 1)")))
    share = "least(greatest(0.02D * atr / (atr + 1e-12D), 0D), 1D)"
    df = df.withColumn("confidence", F.expr(f"({confidence}) * {share}"))
    geometry = {"neckline": "neck", "slope_mean": "cv.slope_mean", "curvature_mean": "cv.curvature_mean", "confidence_breakout": "confidence", **more}
    return df.select(
        *KEYS, F.expr(f"ts[{last} + 1]").alias("timestamp"), F.lit(name).alias("pattern_type"), F.lit("bearish" if side == "top" else "bullish").alias("direction"),
        "confidence", F.col("neck").alias("neckline"), F.col("cv.slope_mean").alias("slope_mean"), F.col("cv.curvature_mean").alias("curvature_mean"),
        F.expr(number_map(features)).alias("features"), F.expr(_lists(lists)).alias("lists"), F.expr(number_map(geometry)).alias("geometry"),
    )


def swings(series: DataFrame) -> DataFrame:
    """Double and triple tops and bottoms, and head and shoulders either way."""
    clip = lambda x: f"least(greatest({x}, 0D), 1D)"
    margin, out = {"depth_tolerance": "0.02D * atr"}, None
    for side, piv, names in (("top", "hi", ("DoubleTop", "TripleTop", "HeadAndShoulders")), ("bottom", "lo", ("DoubleBottom", "TripleBottom", "InverseHeadAndShoulders"))):
        one = series.withColumn("a", F.explode(piv))
        two = one.withColumn("b", F.explode(F.expr(f"filter({piv}, q -> q.i >= a.i + {DISTANCE})")))
        pair = two.withColumn("tol", F.expr("abs(a.p - b.p) / (abs(a.p) + 1e-12D)")).where("tol <= 0.03")
        top = side == "top"
        ends = ("peak1_height", "peak2_height", "height_tolerance") if top else ("valley1_depth", "valley2_depth", "depth_tolerance")
        double = _emit(pair, names[0], side, "a.i", "b.i", clip("1 - tol / 0.05D"), _neck(side, "a.i", "b.i"), dict(zip(ends, ("a.p", "b.p", "tol"), strict=True)), {}, margin)
        three = two.withColumn("d", F.explode(F.expr(f"filter({piv}, q -> q.i >= b.i + {DISTANCE})"))).withColumn("m", F.expr("(a.p + b.p + d.p) / 3"))
        three = three.withColumn("tol", F.expr("greatest(abs(a.p - m), abs(b.p - m), abs(d.p - m)) / (abs(m) + 1e-12D)")).where("tol <= 0.04")
        both = f"{'greatest' if side == 'top' else 'least'}({_neck(side, 'a.i', 'b.i')}, {_neck(side, 'b.i', 'd.i')})"
        spacing = "(1 - least(abs((b.i - a.i) - (d.i - b.i)) / (greatest(b.i - a.i, d.i - b.i) + 1e-12D), 1D))"
        triple = _emit(three, names[1], side, "a.i", "d.i", f"{clip('1 - tol / 0.06D')} * 0.6D + {spacing} * 0.4D", both, {ends[2]: "tol"}, {"peak_heights" if top else "valley_depths": "array(a.p, b.p, d.p)", "peak_spacing": "array(b.i - a.i, d.i - b.i)"}, margin | {"symmetry_score": spacing})
        near = series.where(f"size(hi) > 0 AND size(lo) > 0 AND size({piv}) >= 3").withColumn("k", F.explode(F.expr(f"sequence(0, greatest(size({piv}) - 3, 0))")))
        near = near.select("*", F.expr(f"{piv}[k]").alias("a"), F.expr(f"{piv}[k + 1]").alias("b"), F.expr(f"{piv}[k + 2]").alias("d"))
        head = "b.p >= greatest(a.p, d.p) + 0.05D * atr" if side == "top" else "b.p <= least(a.p, d.p) - 0.05D * atr"
        near = near.where(head).withColumn("tol", F.expr("abs(a.p - d.p) / (abs((a.p + d.p) / 2) + 1e-12D)")).where("tol <= 0.04")
        shoulders = _emit(near, names[2], side, "a.i", "d.i", f"{clip('1 - tol / 0.08D')} * 0.6D + (1 - least(tol / 0.08D, 1D)) * 0.4D", both, {"head_height" if top else "head_depth": "b.p", "shoulder_tolerance": "tol"},
                          {"shoulder_heights" if top else "shoulder_depths": "array(a.p, d.p)"}, {"symmetry_score": "1 - least(tol / 0.08D, 1D)"})
        for df in (double, triple, shoulders):
            out = df if out is None else out.unionByName(df)
    return out


def _tail(n: int, x: str) -> str:
    return f"slice({x}, greatest(size({x}) - {n - 1}, 1), {n})"


def _quadratic(values: str, n: int) -> str:
    """SQL of the quadratic coefficient of a least-squares parabola over n points of [0, 1]: with n fixed, a weighted sum of them."""
    x = np.linspace(0, 1, n)
    weights = np.linalg.pinv(np.stack([x**2, x, np.ones(n)], 1))[0]
    return f"aggregate(zip_with({values}, array({', '.join(f'{w!r}D' for w in weights.tolist())}), (y, w) -> y * w), 0D, (s, z) -> s + z)"


#: Fixed values of the patterns that look at the last candles or pivots: (pattern, direction, confidence, predicate, candle it is stamped with).
#: sh, sl: slopes of the last two high and low pivots; ph, pl: their extremes; k: the candle that confirms.
_PIVOT_RULES = [
    ("AscendingTriangle", "bullish", 0.7, "abs(sh) < 0.0005 AND sl > 0 AND c[k] > ph + m", "k"),
    ("DescendingTriangle", "bearish", 0.7, "sh < 0 AND abs(sl) < 0.0005 AND c[k] < pl - m", "k"),
    ("SymmetricalTriangle", "bullish", 0.6, "sh < 0 AND sl > 0 AND c[k] > ph + m", "k"),
    ("SymmetricalTriangle", "bearish", 0.6, "sh < 0 AND sl > 0 AND c[k] <= ph + m AND c[k] < pl - m", "k"),
    ("BroadeningFormation", "bullish", 0.5, "sh > 0 AND sl < 0 AND c[k] > ph + m", "k"),
    ("BroadeningFormation", "bearish", 0.5, "sh > 0 AND sl < 0 AND c[k] <= ph + m AND c[k] < pl - m", "k"),
    ("RisingWedge", "bearish", 0.6, "sh > 0 AND sl > 0 AND sh < sl AND c[k] < pl - m", "k"),
    ("FallingWedge", "bullish", 0.6, "sh < 0 AND sl < 0 AND sh > sl AND c[k] > ph + m", "k"),
    ("Channels", "bullish", 0.45, "abs(sh - sl) <= 0.0008 AND last > ph + m", "n - 1"),
    ("Channels", "bearish", 0.45, "abs(sh - sl) <= 0.0008 AND last < pl - m", "n - 1"),
]
_TAIL_RULES = [
    ("BullFlag", "bullish", 0.55, "impulse > 0.03 AND (h30 - l30) / (last + 1e-12D) < 0.02 AND drift < 0 AND last > h30 + m"),
    ("BullPennant", "bullish", 0.5, "impulse > 0.03 AND (h30 - l30) / (last + 1e-12D) < 0.02 AND squeeze < 0.8 AND last > h30 + m"),
    ("BearFlag", "bearish", 0.55, "impulse < -0.03 AND (h30 - l30) / (last + 1e-12D) < 0.02 AND drift > 0 AND last < l30 - m"),
    ("BearPennant", "bearish", 0.5, "impulse < -0.03 AND (h30 - l30) / (last + 1e-12D) < 0.02 AND squeeze < 0.8 AND last < l30 - m"),
    ("RectangleRange", "bullish", 0.5, "(h60 - l60) / (last + 1e-12D) <= 0.04 AND last > h60 + m"),
    ("RectangleRange", "bearish", 0.5, "(h60 - l60) / (last + 1e-12D) <= 0.04 AND last < l60 - m"),
    ("SwingFailureBullish", "bullish", 0.6, "low < l30 - m AND last > l30 + m AND last > open"),
    ("SwingFailureBearish", "bearish", 0.6, "high > h30 + m AND last < h30 - m AND last < open"),
    ("LiquiditySweepLow", "bullish", 0.55, "low < l25 - m AND last > l25"),
    ("LiquiditySweepHigh", "bearish", 0.55, "high > h25 + m AND last < h25"),
    ("WyckoffAccumulation", "bullish", 0.45, "(h100 - l100) / (last + 1e-12D) <= 0.08 AND l100 < l100 - m AND spring > l100 + 0.005D * atr"),
    ("WyckoffDistribution", "bearish", 0.45, "(h100 - l100) / (last + 1e-12D) <= 0.08 AND h100 > h100 + m AND thrust < h100 - 0.005D * atr"),
    ("RoundedBottom", "bullish", 0.35, "q120 > 0 AND low_at > 30 AND low_at < 90"),
    ("RoundedTop", "bearish", 0.35, "q120 < 0 AND high_at > 30 AND high_at < 90"),
    ("CupAndHandle", "bullish", 0.4, "q104 > 0 AND array_min(handle) >= array_min(cup) - 0.03D * atr AND last > array_max(cup) + m"),
]


_SLOPES, _CURVE = {"slope_high": "sh", "slope_low": "sl"}, ("least(hi2.i, lo2.i)", "k")
_FLAT, _IMPULSE = {"height_tolerance": "0D", "depth_tolerance": "0D"}, {"impulse_return": "impulse", "range_pct": "(h30 - l30) / (last + 1e-12D)"}
_WYCKOFF = {"support": "l100", "resistance": "h100", "range_pct": "(h100 - l100) / (last + 1e-12D)"}
#: Pattern -> what it reports of itself, the range of its curve (or, for flags, the slope that stands for it), more geometry.
_REPORTS = {
    ("AscendingTriangle", "DescendingTriangle"): (_SLOPES, _CURVE, _FLAT),
    ("SymmetricalTriangle", "BroadeningFormation", "RisingWedge", "FallingWedge"): (_SLOPES, _CURVE, {}),
    ("Channels",): ({"slope_hi": "sh", "slope_lo": "sl"}, ("least(hi2.i, lo2.i)", "n - 1"), {}),
    ("BullFlag", "BearFlag"): (_IMPULSE, "drift", _FLAT),
    ("BullPennant", "BearPennant"): (_IMPULSE | {"contraction": "squeeze"}, "0D", _FLAT),
    ("RectangleRange",): ({"range_pct": "(h60 - l60) / (last + 1e-12D)", "upper": "h60", "lower": "l60"}, ("n - 60", "n - 1"), {}),
    ("SwingFailureBullish",): ({"support": "l30"}, ("n - 30", "n - 1"), {}),
    ("SwingFailureBearish",): ({"resistance": "h30"}, ("n - 30", "n - 1"), {}),
    ("LiquiditySweepLow",): ({"support": "l25"}, ("n - 25", "n - 1"), {}),
    ("LiquiditySweepHigh",): ({"resistance": "h25"}, ("n - 25", "n - 1"), {}),
    ("WyckoffAccumulation", "WyckoffDistribution"): (_WYCKOFF, ("n - 100", "n - 1"), {}),
    ("RoundedBottom", "RoundedTop"): ({"quad_coeff": "q120"}, ("n - 120", "n - 1"), {}),
    ("CupAndHandle",): ({"quad_coeff": "q104", "rim": "array_max(cup)", "handle_low": "array_min(handle)"}, ("n - 160", "n - 1"), {}),
}


def _chosen(df: DataFrame, rules: list[tuple[str, ...]]) -> DataFrame:
    """One row for each rule that holds; a pattern's curve is worked out only then."""
    each = []
    for name, side, confidence, holds, *at in rules:
        features, curve, more = next(v for k, v in _REPORTS.items() if name in k)
        cv = f"named_struct('slope_mean', CAST({curve} AS double), 'curvature_mean', 0D)" if isinstance(curve, str) else _curve(*curve)
        geometry = number_map({"confidence_breakout": f"{confidence}D", "slope_mean": "cv.slope_mean", "curvature_mean": "cv.curvature_mean", **more})
        made = f"""struct(ts[{at[0] if at else 'n - 1'}] AS timestamp, '{name}' AS pattern_type, '{side}' AS direction, {confidence}D AS confidence, cv.slope_mean AS slope_mean,
            cv.curvature_mean AS curvature_mean, {number_map(features)} AS features, {geometry} AS geometry)"""
        each.append(f"CASE WHEN {holds} THEN transform(array({cv}), cv -> {made})[0] END")
    df = df.select(*KEYS, F.inline(F.expr(f"filter(array({', '.join(each)}), x -> x IS NOT NULL)")))
    return df.withColumn("neckline", F.lit(None).cast("double")).withColumn("lists", F.expr(_NO_LISTS)).select(*_COLUMNS)


def by_last_pivots(series: DataFrame) -> DataFrame:
    """Triangles, wedges, broadening formations and channels."""
    df = series.where("size(hi) >= 2 AND size(lo) >= 2").select("*", *[F.expr(f"{s}[size({s}) - {j}]").alias(f"{s}{j}") for s in ("hi", "lo") for j in (2, 1)])
    df = df.select(
        "*", F.expr("(hi1.p - hi2.p) / (hi1.i - hi2.i)").alias("sh"), F.expr("(lo1.p - lo2.p) / (lo1.i - lo2.i)").alias("sl"), F.expr("greatest(hi1.p, hi2.p)").alias("ph"), F.expr("least(lo1.p, lo2.p)").alias("pl"),
        F.expr("least(n - 1, greatest(hi1.i, lo1.i) + 1)").alias("k"), F.expr("0.01D * atr").alias("m"), F.expr("c[n - 1]").alias("last"),
    )
    return _chosen(df, _PIVOT_RULES)


def by_last_candles(series: DataFrame) -> DataFrame:
    """Patterns of the newest candle against the ones before."""
    std = lambda x: f"aggregate(array({x}), 0D, (s, y) -> sqrt(aggregate(y, 0D, (a, z) -> a + pow(z - aggregate(y, 0D, (b, u) -> b + u) / size(y), 2)) / greatest(size(y) - 1, 1)))"
    df = series.select("*", *[F.expr(f"array_max({_tail(k, 'h')})").alias(f"h{k}") for k in (25, 30, 60, 100)], *[F.expr(f"array_min({_tail(k, 'l')})").alias(f"l{k}") for k in (25, 30, 60, 100)])
    df = df.select(
        "*", F.expr("c[n - 1]").alias("last"), F.expr("o[n - 1]").alias("open"), F.expr("h[n - 1]").alias("high"), F.expr("l[n - 1]").alias("low"), F.expr("0.01D * atr").alias("m"),
        F.expr("c[n - 1] / c[greatest(n - 80, 0)] - 1").alias("impulse"), F.expr(_tail(30, "c")).alias("c30"), F.expr("slice(c, greatest(n - 59, 1), 30)").alias("c60"),
        F.expr(_tail(120, "c")).alias("c120"), F.expr("slice(c, n - 159, 104)").alias("cup"), F.expr("slice(c, n - 55, 56)").alias("handle"),
    )
    df = df.select(
        "*", F.expr("aggregate(sequence(0, 29), 0D, (s, i) -> s + (i - 14.5D) * c30[i]) / 2247.5D").alias("drift"), F.expr(f"({std('c30')}) / (({std('c60')}) + 1e-12D)").alias("squeeze"),
        F.expr("c[n - 100 + array_position(" + _tail(100, "l") + ", l100) - 1]").alias("spring"), F.expr("c[n - 100 + array_position(" + _tail(100, "h") + ", h100) - 1]").alias("thrust"),
        F.expr(_quadratic("c120", 120)).alias("q120"), F.expr("array_position(c120, array_min(c120)) - 1").alias("low_at"), F.expr("array_position(c120, array_max(c120)) - 1").alias("high_at"),
        F.expr(_quadratic("cup", 104)).alias("q104"),
    )
    return _chosen(df, _TAIL_RULES)


def retests(series: DataFrame) -> DataFrame:
    """Breakouts from a narrow range of 50 candles within the last 30, each with a retest in the ten candles after."""
    df = series.select("*", F.expr("array_max(slice(h, n - 79, 50))").alias("u"), F.expr("array_min(slice(l, n - 79, 50))").alias("d"), F.expr("0.01D * atr").alias("m"))
    df = df.where("(u - d) / (c[n - 31] + 1e-12D) <= 0.06").withColumn("i", F.explode(F.expr("sequence(n - 30, n - 2)")))
    after = "sequence(i + 1, least(i + 10, n - 1))"
    up = df.where("c[i] > u + m").where(f"exists({after}, j -> l[j] <= u + m AND c[j] > u - m)").withColumn("direction", F.lit("bullish"))
    down = df.where("c[i] < d - m").where(f"exists({after}, j -> h[j] >= d - m AND c[j] < d + m)").withColumn("direction", F.lit("bearish"))
    both = up.unionByName(down).withColumn("cv", F.expr(_curve("n - 80", "n - 1")))
    geometry = {"confidence_breakout": "0.55D", "slope_mean": "cv.slope_mean", "curvature_mean": "cv.curvature_mean"}
    features = {"range_upper": "u", "range_lower": "d", "range_pct": "(u - d) / (c[n - 31] + 1e-12D)"}
    return both.select(
        *KEYS, F.expr("ts[i]").alias("timestamp"), F.lit("BreakoutRetest").alias("pattern_type"), "direction", F.lit(0.55).alias("confidence"), F.lit(None).cast("double").alias("neckline"), "cv.slope_mean", "cv.curvature_mean",
        F.expr(number_map(features)).alias("features"), F.expr(_NO_LISTS).alias("lists"), F.expr(number_map(geometry)).alias("geometry"),
    )


def detect(candles: DataFrame) -> DataFrame:
    """All chart patterns of all series with at least 200 candles. The pivots, one row a series, are written once and read by each family."""
    series = written(with_pivots(segments(candles)), "chart-series")
    return swings(series).unionByName(by_last_pivots(series)).unionByName(by_last_candles(series)).unionByName(retests(series))
