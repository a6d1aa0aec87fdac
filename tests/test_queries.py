"""Every registered query with SQL, against DuckDB on the smallest tables; those without, for running at all."""

import math

import duckdb
import pytest

from candlewick.plans.oracles import ORACLES
from candlewick.plans.queries import QUERIES

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return c


def plain(v):
    return round(v, 6) + 0.0 if isinstance(v, float) and not math.isnan(v) else v


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, DIR)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=str)
    if name not in ORACLES:
        assert got and not any(isinstance(v, float) and math.isnan(v) for r in got for v in r)
        assert len({str(r) for r in got}) > 0.5 * len(got)
        return
    cursor = con.execute(ORACLES[name])
    names = [x[0] for x in cursor.description]
    assert sorted(names) == columns
    want = sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in cursor.fetchall()), key=str)
    assert got == want


def test_keys_match():
    assert set(ORACLES) <= set(QUERIES)


def test_chart_patterns_are_those_of_the_families(spark):
    """chart.detect is the union of its families, whose rows have SQL, on planted series as well."""
    from candlewick.operators import chart
    from candlewick.plans import queries

    for source in (queries._planted(spark, DIR, True), queries.candles.daily(spark, DIR)):
        series = chart.with_pivots(chart.segments(source))
        columns = ["symbol", "timestamp", "pattern_type", "direction", "confidence", "neckline", "slope_mean", "curvature_mean"]
        parts = [f(series).select(columns) for f in (chart.swings, chart.by_last_pivots, chart.by_last_candles, chart.retests)]
        want = sorted(str(tuple(r)) for p in parts for r in p.collect())
        found = chart.detect(source)
        assert sorted(str(tuple(r)) for r in found.select(columns).collect()) == want and want
        for r in found.collect():
            assert r.geometry["slope_mean"] == r.slope_mean and r.geometry["curvature_mean"] == r.curvature_mean and r.geometry.get("neckline") == r.neckline
            assert r.geometry["confidence_breakout"] == r.confidence and (r.features or r.pattern_type == "none")
