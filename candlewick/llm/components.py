"""Connected components of a link table by alternating large-star and small-star steps, without collecting links anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candlewick.session import discard, written


def _least(pairs: DataFrame) -> DataFrame:
    """u and the least of its neighbours and itself."""
    return pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))


def components(links: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """(node, root) for every node that has a link; root is the least node of its component.

    Each step is a grouped minimum, combined before it is shuffled, and an equi-join of two written tables, which can be split where a
    node has very many links. The number of steps grows with the logarithm of the longest chain; if they don't settle within `rounds`, an
    error is raised, as components would be torn. Null ends are ignored; a table without links gives no rows.
    """
    edges = written(links.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "cc-edges")
    before, n = None, edges.count()

    def table(df: DataFrame, label: str) -> DataFrame:
        """Written by no more tasks than the rows call for."""
        tasks = 4 + n // 100_000
        return written(df.coalesce(tasks) if tasks < int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df, label)

    for turn in range(rounds + 1 if n else 0):
        if turn == rounds:
            raise RuntimeError(f"components didn't settle in {rounds} rounds")
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = table(_least(both), "cc-least")
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = table(large, "cc-large")
        discard(least, edges)
        least = table(_least(large), "cc-least")
        joined = large.join(least, "u")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(joined.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        edges = table(small, "cc-edges")
        discard(large, least)
        state = tuple(edges.agg(F.count(F.lit(1)), F.coalesce(F.expr("bit_xor(xxhash64(u, v))"), F.lit(0))).first())
        n = state[0]
        if state == before:
            break
        before = state
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
