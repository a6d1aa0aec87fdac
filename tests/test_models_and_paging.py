import os
import sys
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from candlewick.operators import models
from candlewick.sources.paged import PagedCandles


def _rows(spark, n=300):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(n, 3)) * [1, 5, 0.1] + [0, 2, 1]
    y = (x @ [1, 0.2, 3] + rng.normal(size=n) > 3.5).astype(int)
    r = x @ [0.5, -0.1, 2] + rng.normal(size=n)
    df = spark.createDataFrame([(i, x[i].tolist(), int(y[i]), float(r[i])) for i in range(n)], "id int, v array<double>, y_dir int, y_return double")
    return df, (x - x.mean(0)) / x.std(0), y, r


def test_ridge_equals_closed_form(spark):
    df, z, _, r = _rows(spark)
    got = {a.id: a.prediction for a in models.return_model(models.scaled(df, "v")).transform(models.scaled(df, "v")).collect()}
    w = np.linalg.solve(z.T @ z + np.eye(3), z.T @ (r - r.mean()))
    assert [got[i] for i in range(len(r))] == pytest.approx((z @ w + r.mean()).tolist(), abs=1e-6)


@pytest.mark.parametrize("balanced", [False, True])
def test_logistic_equals_newton(spark, balanced):
    df, z, y, _ = _rows(spark)
    got = {a.id: a.p for a in models.probability(models.direction_model(models.scaled(df, "v"), balanced=balanced), models.scaled(df, "v")).collect()}
    a, w = np.c_[z, np.ones(len(y))], np.zeros(4)
    s = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (1 - y).sum())) if balanced else np.ones(len(y))
    for _ in range(50):
        p = 1 / (1 + np.exp(-a @ w))
        w -= np.linalg.solve(a.T * (s * p * (1 - p)) @ a + np.diag([1, 1, 1, 0]), a.T @ (s * (p - y)) + w * [1, 1, 1, 0])
    assert [got[i] for i in range(len(y))] == pytest.approx((1 / (1 + np.exp(-a @ w))).tolist(), abs=1e-4)


def test_paged_source(spark):
    here = str(Path(__file__).parent)
    os.environ["PYTHONPATH"] = os.pathsep.join([here, os.environ.get("PYTHONPATH", "")])
    spark.sparkContext.addPyFile(str(Path(here) / "paged_service.py"))
    sys.path.insert(0, here)
    spark.dataSource.register(PagedCandles)
    read = lambda **o: spark.read.format("paged_candles").options(fetch="paged_service:fetch", timeframes="1h", pause="0.01", tries="2", **o).load()
    got = read(exchanges="first,second", symbols="A/U,B/U", since="1")
    assert {(r.symbol, r.n, r.k) for r in got.groupBy("symbol").agg(F.count("*").alias("n"), F.count_distinct("exchange").alias("k")).collect()} == {("A/U", 9, 1), ("B/U", 9, 2)}
    assert got.agg(F.sum("close")).first()[0] == 90.0
    with pytest.raises(Exception, match="no exchange answered"):
        read(exchanges="none", symbols="A/U").collect()
