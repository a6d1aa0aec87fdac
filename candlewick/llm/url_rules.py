"""URL allow and block rules by hashed expressions.

A url is expanded into host suffixes and path prefixes, only of the shapes (labels of the host, characters of the path) that some rule
has. Each expression is hashed; an equi-join on the first four bytes of the hash finds candidate rules, the full digest confirms them,
and the longest confirmed rule decides (then the longer host, then block).

Defined cases: a null url, or one without "://", has empty host and path and fits no rule; urls that no rule fits get `default`; rules
with a null host or verdict are dropped, a null path is empty; of rules for the same host and path, block wins; every input row gives
one row, repeated rows too; an empty table gives no rows; other columns of the input are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PREFIX_HEX = 8


def host_of(url: Column) -> Column:
    """After the first :// up to / ? # or the end, A-Z lower-cased; empty where there is none."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host, up to ? # or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    """(verdict, host, path) rows as a table."""
    return spark.createDataFrame(rules, "verdict string, host string, path string")


def judge(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow", broadcast_rules: int = 1_000_000) -> DataFrame:
    """id, host, path, rule (host and path of the rule that decides, else null) and verdict of every row.

    The rules are broadcast only if there are at most `broadcast_rules` of them; else the join is dealt out by hash prefix.
    """
    keyed = (
        rules.where(F.col("host").isNotNull() & F.col("verdict").isNotNull())
        .select("verdict", F.translate("host", UPPER, LOWER).alias("r_host"), F.coalesce("path", F.lit("")).alias("r_path"))
        .groupBy("r_host", "r_path")
        .agg(F.max("verdict").alias("r_verdict"))
        .withColumn("rule", F.concat("r_host", "r_path"))
        .withColumn("r_digest", F.sha2(F.concat("r_host", F.lit("\n"), "r_path"), 256))  # a path needn't begin with a slash
        .withColumn("prefix", F.substring("r_digest", 1, PREFIX_HEX))
    )
    shapes = keyed.select(F.size(F.split("r_host", r"\.")).alias("labels"), F.length("r_path").alias("chars")).distinct().collect()
    urls = pages.select(F.col(id_col).alias("page_id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    # Repeated rows are counted, not carried; a host or url of many pages is spread by page.
    urls = urls.groupBy("page_id", "host", "path").agg(F.count(F.lit(1)).alias("n"))
    made = [
        F.when((F.size(F.split("host", r"\.")) >= s.labels) & (F.length("path") >= s.chars), F.concat(F.substring_index("host", ".", -s.labels), F.lit("\n"), F.substring("path", 1, s.chars)))
        for s in shapes
    ]
    expressions = F.array_compact(F.array(*made)) if made else F.array().cast("array<string>")
    x = urls.withColumn("expression", F.explode_outer(expressions))
    x = x.withColumn("digest", F.sha2("expression", 256)).withColumn("prefix", F.substring("digest", 1, PREFIX_HEX))
    few = keyed.limit(broadcast_rules + 1).count() <= broadcast_rules
    hit = x.join(F.broadcast(keyed) if few else keyed, "prefix", "left")
    rank = F.struct(F.length("rule"), F.length("r_host"), F.col("r_verdict") == "block", F.col("rule"), F.col("r_verdict").alias("verdict"))
    best = hit.groupBy("page_id", "host", "path", "n").agg(F.max(F.when(F.col("digest") == F.col("r_digest"), rank)).alias("best"))
    return best.select(
        "page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"), F.explode(F.expr("sequence(1L, n)")).alias("copy")
    ).drop("copy")
