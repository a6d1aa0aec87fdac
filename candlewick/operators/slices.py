"""Long series in slices of bounded length, so that what runs along a series is spread over tasks.

A series (the rows of a key, in an order) is range-sorted and cut into slices. What an operator needs to know of the rows before a slice is
worked out in three steps: each slice gives a small summary, the summaries (a few rows a slice) are scanned in order, and each slice goes on
from what the scan gives it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from candlewick.session import written

#: Rows of a slice at most.
SLICE = 100_000


def is_long(rows: DataFrame, key: list[str], short: int | None) -> bool:
    """Whether some key has more than `short` rows; without that, they aren't counted."""
    return short is not None and bool(rows.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > short).limit(1).count())


def sliced(rows: DataFrame, key: list[str], order: list[str], length: int = SLICE) -> DataFrame:
    """rows, written once, with __slice: numbers that ascend within a key as `order` (columns, those with "-" before them falling) does. A
    slice's rows lie in one file, in order.

    The row's own number is the last key of the ranges, so neither a key nor equal places in the order fill a task.
    """
    dealt = rows.withColumn("__row", F.monotonically_increasing_id())
    by = [*[F.asc(c) for c in key], *[F.desc(c[1:]) if c.startswith("-") else F.asc(c) for c in order], F.asc("__row")]
    dealt = dealt.repartitionByRange(*by).sortWithinPartitions(*by).drop("__row")
    place = F.monotonically_increasing_id()  # the partition's number, and the row's in it
    number = F.shiftright(place, 33) * (1 << 20) + F.floor(place.bitwiseAND((1 << 33) - 1) / length)
    return written(dealt.withColumn("__slice", number.cast("long")), "slices")


def within(key: list[str]) -> W:
    return W.partitionBy(*key, "__slice")


def before(key: list[str]) -> W:
    """Over a table of a row per slice: the slices before."""
    return W.partitionBy(*key).orderBy("__slice").rowsBetween(W.unboundedPreceding, -1)


def carried(rows: DataFrame, key: list[str], summary: dict[str, Column], scan: dict[str, Column]) -> DataFrame:
    """rows (as sliced gives them) with the columns of `scan`: aggregates over the slices before, of the columns of `summary`, which are aggregates
    of a slice. Null where there is no slice before."""
    each = rows.groupBy(*key, "__slice").agg(*[v.alias(k) for k, v in summary.items()])
    each = written(each.select(*key, "__slice", *[v.over(before(key)).alias(k) for k, v in scan.items()]), "slice-carries")
    return rows.join(each, [*key, "__slice"])


def order_statistics(rows: DataFrame, by: list[str], value: str, wanted: DataFrame, widths: tuple[int, ...] = (86_400_000, 60_000, 1)) -> DataFrame:
    """Of each key the values (integers) at the places `k` (from 0) of their order: by, k, value. wanted: by, k.

    Histograms are refined: values are counted in buckets of the first width, then those in the buckets that hold wanted places in buckets of
    the next one, and so on, for all keys together. A window sees a key's buckets of one width within one of the width before.
    """
    held, counts = [*by, "k"], F.count(F.lit(1)).alias("c")
    bucket = lambda width: F.floor(F.col(value) / width).cast("long")
    found = wanted.select(*held, F.col("k").alias("left"), F.lit(None).cast("long").alias("in"))
    for last, width in zip((None, *widths), widths, strict=False):
        if last is None:
            each = rows.groupBy(*by, bucket(width).alias("b")).agg(counts).join(found, by)
        else:
            inside = rows.select(*by, bucket(last).alias("in"), F.col(value))
            each = inside.join(found.select(*by, "in").distinct(), [*by, "in"]).groupBy(*by, "in", bucket(width).alias("b")).agg(counts).join(found, [*by, "in"])
        w = W.partitionBy(*held).orderBy("b").rowsBetween(W.unboundedPreceding, -1)
        each = each.withColumn("n", F.coalesce(F.sum("c").over(w), F.lit(0)))
        found = written(each.where("n <= left AND left < n + c").select(*held, (F.col("left") - F.col("n")).alias("left"), F.col("b").alias("in")), "order-statistics")
    return found.select(*held, F.col("in").alias("value"))
