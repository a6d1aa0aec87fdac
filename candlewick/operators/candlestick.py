"""Candlestick patterns: one wide window pass, then an array of the patterns whose predicates hold, exploded.

Names in the predicates: o h l c rng body bp up lo of the candle (bp, up, lo: body and wicks as shares of the range), with 1 of the one
before and 0 of the one before that; idx is the row's place, n the series' rows, slope the trend of the closes before.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from candlewick.operators.indicators import trend_slope
from candlewick.sources.candles import series_window

_SIDE = "CASE WHEN c > o THEN 'bullish' WHEN c < o THEN 'bearish' ELSE 'neutral' END"
_DRAGON, _GRAVE, _LONG = "(lo >= 0.5 AND up <= 0.2)", "(up >= 0.5 AND lo <= 0.2)", "(lo >= 0.35 AND up >= 0.35)"
_HAMMER, _STAR = "lo >= 0.6 AND bp <= 0.3 AND up <= 0.25", "up >= 0.6 AND bp <= 0.3 AND lo <= 0.25"
_UPDOWN, _DOWNUP = "c1 > o1 AND c < o", "c1 < o1 AND c > o"
_BODIES = "body0 / (rng0 + 1e-12) > 0.2 AND body1 / (rng1 + 1e-12) > 0.2 AND body / (rng + 1e-12) > 0.2 AND idx < n - 1"

#: Fixed values: (pattern, direction, confidence, least idx, predicate).
PATTERNS = [
    ("DragonflyDoji", "CASE WHEN c >= o THEN 'bullish' ELSE 'bearish' END", 0.6, 2, f"bp <= 0.1 AND {_DRAGON}"),
    ("GravestoneDoji", "CASE WHEN c <= o THEN 'bearish' ELSE 'bullish' END", 0.6, 2, f"bp <= 0.1 AND NOT {_DRAGON} AND {_GRAVE}"),
    ("LongLeggedDoji", "'neutral'", 0.55, 2, f"bp <= 0.1 AND NOT {_DRAGON} AND NOT {_GRAVE} AND {_LONG}"),
    ("Doji", "'neutral'", 0.5, 2, f"bp <= 0.1 AND NOT {_DRAGON} AND NOT {_GRAVE} AND NOT {_LONG}"),
    ("HangingMan", "'bearish'", 0.55, 2, f"{_HAMMER} AND slope > 0 AND c <= o + 0.2 * rng"),
    ("Hammer", "'bullish'", 0.55, 2, f"{_HAMMER} AND NOT (slope > 0 AND c <= o + 0.2 * rng)"),
    ("ShootingStar", "'bearish'", 0.55, 2, f"{_STAR} AND slope < 0 AND c >= o - 0.2 * rng"),
    ("InvertedHammer", "CASE WHEN slope < 0 THEN 'bearish' ELSE 'bullish' END", 0.5, 2, f"{_STAR} AND NOT (slope < 0 AND c >= o - 0.2 * rng)"),
    ("SpinningTop", "'neutral'", 0.45, 2, "bp <= 0.25 AND lo >= 0.3 AND up >= 0.3"),
    ("Marubozu", _SIDE, 0.65, 2, "up <= 0.03 AND lo <= 0.03"),
    ("BeltHold", "'bullish'", 0.55, 2, "c > o AND lo <= 0.05 AND c >= h - 0.05 * rng"),
    ("BeltHold", "'bearish'", 0.55, 2, "c < o AND up <= 0.05 AND c <= l + 0.05 * rng"),
    ("BullishEngulfing", "'bullish'", 0.6, 1, f"{_DOWNUP} AND o < c1 AND c > o1"),
    ("BearishEngulfing", "'bearish'", 0.6, 1, f"{_UPDOWN} AND o > c1 AND c < o1"),
    ("Harami", "'bullish'", 0.45, 1, f"{_DOWNUP} AND body < body1 AND o > c1 AND c < o1"),
    ("HaramiCross", "'bullish'", 0.5, 1, f"{_DOWNUP} AND body < body1 AND o > c1 AND c < o1 AND bp <= 0.1"),
    ("Harami", "'bearish'", 0.45, 1, f"{_UPDOWN} AND body < body1 AND o < c1 AND c > o1"),
    ("HaramiCross", "'bearish'", 0.5, 1, f"{_UPDOWN} AND body < body1 AND o < c1 AND c > o1 AND bp <= 0.1"),
    ("DarkCloudCover", "'bearish'", 0.6, 1, f"{_UPDOWN} AND o >= c1 AND c <= (o1 + c1) / 2.0 AND c > l1"),
    ("PiercingLine", "'bullish'", 0.6, 1, f"{_DOWNUP} AND o <= c1 AND c >= (o1 + c1) / 2.0 AND c < o1"),
    ("InsideBar", "'neutral'", 0.4, 1, "h <= h1 AND l >= l1"),
    ("OutsideBar", _SIDE, 0.4, 1, "h >= h1 AND l <= l1"),
    ("TweezerTop", "'bearish'", 0.55, 1, f"abs(h - h1) / (h1 + 1e-12) <= 0.01 AND {_UPDOWN}"),
    ("TweezerBottom", "'bullish'", 0.55, 1, f"abs(l - l1) / (l1 + 1e-12) <= 0.01 AND {_DOWNUP}"),
    ("Kicker", "'bullish'", 0.6, 1, f"{_DOWNUP} AND bp1 <= 0.2 AND body >= 1.2 * body1 AND c > h1"),
    ("Kicker", "'bearish'", 0.6, 1, f"{_UPDOWN} AND bp1 <= 0.2 AND body >= 1.2 * body1 AND c < l1"),
    ("MorningStar", "'bullish'", 0.55, 2, "c0 < o0 AND bp1 <= 0.35 AND c > (o0 + c0) / 2.0 AND c > o"),
    ("MorningDojiStar", "'bullish'", 0.6, 2, "c0 < o0 AND bp1 <= 0.1 AND c > (o0 + c0) / 2.0 AND c > o"),
    ("EveningStar", "'bearish'", 0.55, 2, "c0 > o0 AND bp1 <= 0.35 AND c < (o0 + c0) / 2.0 AND c < o"),
    ("EveningDojiStar", "'bearish'", 0.6, 2, "c0 > o0 AND bp1 <= 0.1 AND c < (o0 + c0) / 2.0 AND c < o"),
    ("ThreeWhiteSoldiers", "'bullish'", 0.6, 2, f"c0 > o0 AND c1 > o1 AND c > o AND c1 > c0 AND c > c1 AND {_BODIES} AND o1 <= c0 AND o1 >= o0 AND o <= c1 AND o >= o1"),
    ("ThreeBlackCrows", "'bearish'", 0.6, 2, f"c0 < o0 AND c1 < o1 AND c < o AND c1 < c0 AND c < c1 AND {_BODIES} AND o1 >= c0 AND o1 <= o0 AND o >= c1 AND o <= o1"),
]


#: What a pattern reports of itself. BeltHold's depends on its direction.
FEATURES = {
    ("DragonflyDoji", "GravestoneDoji", "LongLeggedDoji", "Doji", "SpinningTop", "Marubozu", "HaramiCross"): {"body_pct": "bp"},
    ("HangingMan", "Hammer"): {"lower_wick_pct": "lo"},
    ("ShootingStar", "InvertedHammer"): {"upper_wick_pct": "up"},
    ("BeltHold", "'bullish'"): {"lo_pct": "lo"},
    ("BeltHold", "'bearish'"): {"up_pct": "up"},
    ("BullishEngulfing", "BearishEngulfing"): {"prev_body_pct": "bp1", "next_body_pct": "bp"},
    ("Harami",): {"harami_body_ratio": "body / (body1 + 1e-12D)"},
    ("DarkCloudCover", "PiercingLine"): {"mid": "(o1 + c1) / 2D"},
    ("InsideBar", "OutsideBar"): {"range_pct": "rng / (rng1 + 1e-12D)"},
    ("TweezerTop",): {"height_tolerance": "abs(h - h1) / (h1 + 1e-12D)"},
    ("TweezerBottom",): {"depth_tolerance": "abs(l - l1) / (l1 + 1e-12D)"},
    ("Kicker",): {"body1_pct": "bp1", "body2": "body"},
    ("MorningStar", "EveningStar"): {"mid": "(o0 + c0) / 2D"},
    ("MorningDojiStar", "EveningDojiStar"): {"mid": "(o0 + c0) / 2D", "star_doji_body_pct": "bp1"},
    ("ThreeWhiteSoldiers", "ThreeBlackCrows"): {},
}


def number_map(pairs: dict[str, str]) -> str:
    """SQL of a map of names to numbers, given as expressions."""
    return "CAST(map({}) AS map<string,double>)".format(", ".join(f"'{k}', CAST({v} AS double)" for k, v in pairs.items()))


def _features(name: str, side: str) -> str:
    found = next(v for k, v in FEATURES.items() if (name in k and not k[-1].startswith("'")) or k == (name, side))
    return number_map(found)


def shapes(candles: DataFrame) -> DataFrame:
    """The candles with the names of the predicates."""
    w = series_window()
    df = candles.select(
        "exchange", "symbol", "timeframe", "timestamp", "close", F.col("open").alias("o"), F.col("high").alias("h"), F.col("low").alias("l"), F.col("close").alias("c"),
        F.greatest(F.col("high") - F.col("low"), F.lit(1e-12)).alias("rng"), F.abs(F.col("close") - F.col("open")).alias("body"), (F.row_number().over(w) - 1).alias("idx"),
        F.count(F.lit(1)).over(w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)).alias("n"),
    )
    df = df.select("*", (F.col("body") / F.col("rng")).alias("bp"), ((F.col("h") - F.greatest("o", "c")) / F.col("rng")).alias("up"), ((F.least("o", "c") - F.col("l")) / F.col("rng")).alias("lo"))
    back = [F.lag(x, k).over(w).alias(f"{x}{name}") for k, name in ((1, 1), (2, 0)) for x in ("o", "h", "l", "c", "rng", "body", "bp")]
    return df.select("*", *back, trend_slope().alias("slope")).where("n >= 5")


def detect(candles: DataFrame) -> DataFrame:
    """(exchange, symbol, timeframe, timestamp, pattern_type, direction, confidence) of every pattern at every candle, with what it reports of
    itself (features) and its geometry, as maps of numbers."""
    each = ", ".join(
        f"CASE WHEN idx >= {least} AND {p} THEN struct('{name}' AS pattern_type, {side} AS direction, {conf}D AS confidence, {_features(name, side)} AS features, {number_map({'confidence_breakout': f'{conf}D'})} AS geometry) END"
        for name, side, conf, least, p in PATTERNS
    )
    found = F.expr(f"filter(array({each}), x -> x IS NOT NULL)")
    return shapes(candles).select("exchange", "symbol", "timeframe", "timestamp", F.inline(found))


def best(instances: DataFrame) -> DataFrame:
    """Of instances with one pattern type at one candle, the one with the highest confidence; candlesticks before charts, then by direction."""
    keys = ["exchange", "symbol", "timeframe", "timestamp", "pattern_type"]
    detector = F.col("detector") if "detector" in instances.columns else F.lit(0)
    first = F.struct(F.negative("confidence"), detector, "direction")
    more = [c for c in ("features", "geometry") if c in instances.columns]
    return instances.groupBy(*keys).agg(F.max("confidence").alias("confidence"), *[F.min_by(c, first).alias(c) for c in ("direction", *more)])
