"""Report sinks and sources: curves and trades as CSV, metrics as JSON, patterns as Parquet or CSV, and configuration."""

from __future__ import annotations

import ast
import json
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from candlewick.operators import backtest


def write(taken: DataFrame, curve: DataFrame, cfg: backtest.BacktestConfig, path: str) -> None:
    """equity_curve, drawdown_curve, trades (CSV) and metrics (JSON) below the folder, each partitioned by policy."""
    csv = lambda df, name: df.write.mode("overwrite").partitionBy("policy").option("header", True).csv(f"{path}/{name}")
    csv(curve.orderBy("policy", "number").select("policy", "timestamp", "equity"), "equity_curve")
    csv(curve.orderBy("policy", "number").select("policy", "timestamp", "drawdown"), "drawdown_curve")
    csv(taken.orderBy("policy", "number"), "trades")
    backtest.metrics(taken, curve, cfg).write.mode("overwrite").partitionBy("policy").json(f"{path}/metrics")


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    """Metrics documents of a report folder; documents that can't be read are skipped, missing metrics are null."""
    schema = ", ".join(f"{m} {'long' if m == 'trade_count' else 'double'}" for m in backtest.METRICS)
    return spark.read.schema(f"policy string, {schema}").option("mode", "DROPMALFORMED").json(f"{path}/metrics")


def patterns_as_csv(patterns: DataFrame, path: str) -> None:
    """Patterns as CSV with nested columns as JSON text."""
    nested = {c for c, t in patterns.dtypes if t.startswith(("map", "array", "struct"))}
    patterns.select(*[F.to_json(c).alias(c) if c in nested else F.col(c) for c in patterns.columns]).write.mode("overwrite").option("header", True).csv(path)


class _Names(ast.NodeTransformer):
    """nan and inf stand bare in a printed value; there is no number for them in JSON."""

    def visit_Name(self, node: ast.Name) -> ast.AST:  # noqa: N802
        return ast.Constant(None) if node.id in ("nan", "inf") else node

    def visit_UnaryOp(self, node: ast.UnaryOp) -> ast.AST:  # noqa: N802
        return ast.Constant(None) if isinstance(node.operand, ast.Name) and node.operand.id in ("nan", "inf") else node


def _json_of(text: str | None) -> str | None:
    if text is None:
        return None
    try:
        value = ast.literal_eval(_Names().visit(ast.parse(text.strip(), mode="eval")))
        return json.dumps(value, default=lambda v: sorted(v) if isinstance(v, (set, frozenset)) else str(v))
    except (ValueError, SyntaxError, TypeError, MemoryError, RecursionError):
        return None


def _literals_as_json(texts: pd.Series) -> pd.Series:
    return texts.map(_json_of)


def literal(text: str, schema: str) -> Column:
    """A column of Python literals (any quotes and escapes, tuples, None, True, False) as a nested value. nan and inf are null, as is a text that is
    no literal."""
    return F.from_json(F.pandas_udf(_literals_as_json, StringType())(F.col(text)), schema)


#: The nested columns of pattern records.
NESTED = {
    "detector_features": "map<string,double>",
    "geometry_metrics": "map<string,double>",
    "volatility_context": "struct<atr:double,atr_percent:double,regime:string>",
    "volume_context": "map<string,double>",
    "forward_returns": "map<string,double>",
    "embedding": "array<double>",
}


def patterns_from_csv(spark: SparkSession, path: str) -> DataFrame:
    """Pattern records of CSV files whose nested columns are Python literals or JSON; a column that isn't there is left out."""
    rows = spark.read.option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"').csv(path)
    kinds = {"timestamp": "long", "confidence": "double"}
    return rows.select(*[(literal(c, NESTED[c]) if c in NESTED else F.col(c).cast(kinds.get(c, "string"))).alias(c) for c in rows.columns])


def symbols(names: Iterable[str]) -> list[str]:
    """Stripped, sorted, each once; every one needs a slash."""
    out = sorted({n.strip() for n in names})
    if bad := [n for n in out if "/" not in n]:
        raise ValueError(f"not a symbol: {bad}")
    return out


def trigger_timeframes(configured: list[str], wanted: list[str] | None = None) -> list[str]:
    """The wanted ones; else 1d and 4h if both are configured, else all."""
    return wanted or (["1d", "4h"] if {"1d", "4h"} <= set(configured) else list(configured))
