"""Event curves, their geometry, and the 64-number embedding of an event."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from candlewick.functions.scalars import curvature_mean, dtw, multi_hot, resampled, slope_mean
from candlewick.sources.candles import series_window

HALF, POINTS, SIGNATURE = 24, 32, 48
#: The geometry numbers of an embedding, in order.
GEOMETRY = ["confidence_breakout", "symmetry_score", "curvature_mean", "slope_mean", "shape_dtw_to_u", "shape_dtw_to_invu", "height_tolerance", "depth_tolerance"]


def worked_out(df: DataFrame, **columns: Column) -> DataFrame:
    """Adds columns behind a generator, so that later expressions read them instead of working them out anew at every mention."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(k) for k, c in columns.items()]))))


def with_curve(candles: DataFrame) -> DataFrame:
    """Adds seg: the closes from 24 rows before to 24 rows after."""
    w = series_window().rowsBetween(-HALF, HALF)
    return candles.select("*", F.collect_list("close").over(w).alias("seg"))


def enriched(rows: DataFrame, seg: str = "seg") -> DataFrame:
    """Adds curvature_mean and slope_mean of the curve's signature, and its distances to a valley and its inverse.

    The signature is the last 48 closes over the first of them, resampled to 32; the distances use the whole segment, likewise.
    """
    of = lambda x: f"transform({x}, v -> v / IF({x}[0] = 0, 1D, {x}[0]))"
    sig = f"slice({seg}, greatest(size({seg}) - {SIGNATURE - 1}, 1), {SIGNATURE})"
    df = rows.withColumn("__s", F.expr(sig)).withColumn("__s", F.expr(of("__s"))).withColumn("__w", F.expr(of(seg)))
    df = df.withColumn("__s", F.expr(resampled("__s", POINTS))).withColumn("__w", F.expr(resampled("__w", POINTS)))
    df = df.withColumn("__u", F.expr(f"transform(sequence(0, {POINTS - 1}), i -> pow(i / {POINTS - 1}D - 0.5D, 2) / (0.25D + 1e-12D))")).withColumn("__v", F.expr("transform(__u, x -> 1D / (x + 1e-12D))"))
    made = {"curvature_mean": curvature_mean("__s"), "slope_mean": slope_mean("__s"), "shape_dtw_to_u": dtw("__w", "__u"), "shape_dtw_to_invu": dtw("__w", "__v")}
    return worked_out(df, **{k: F.expr(e) for k, e in made.items()}).drop("__s", "__w", "__u", "__v")


def merged(rows: DataFrame) -> DataFrame:
    """The geometry map with the curve's numbers that enriched() added, which replace the detector's own."""
    mine = ["curvature_mean", "slope_mean", "shape_dtw_to_u", "shape_dtw_to_invu"]
    kept = F.map_filter("geometry", lambda k, _: ~k.isin(*mine))
    whole = F.map_concat(kept, F.create_map(*[x for k in mine for x in (F.lit(k), F.col(k))]))
    return worked_out(rows, __g=whole).drop("geometry").withColumnRenamed("__g", "geometry")


def embedded(rows: DataFrame) -> DataFrame:
    """Adds embedding: 24 hash places of the pattern, the geometry map's numbers, volatility, regime (low 0, high 1, else a half), ten
    detector numbers by key, ten pairs of zeros; of length 1 unless all is 0. rows: pattern_type, geometry and features (maps), atr_pct, regime."""
    hot = multi_hot("pattern_type")
    geometry = F.array(*[F.coalesce(F.col("geometry")[k], F.lit(0.0)) for k in GEOMETRY])
    level = F.when(F.col("regime") == "low", 0.0).when(F.col("regime") == "high", 1.0).otherwise(0.5)
    ten = F.expr("slice(concat(transform(array_sort(map_keys(features)), k -> features[k]), array_repeat(0D, 10)), 1, 10)")
    df = worked_out(rows, __e=F.concat(hot, geometry, F.array(F.coalesce("atr_pct", F.lit(0.0)), level), ten, F.array_repeat(F.lit(0.0), 20)))
    df = worked_out(df, __n=F.expr("sqrt(aggregate(__e, 0D, (s, x) -> s + x * x))"))
    return worked_out(df, embedding=F.expr("transform(__e, x -> IF(__n > 0, x / __n, x))")).drop("__e", "__n")
