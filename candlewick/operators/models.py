"""Direction and return models on Spark ML, scaled so that they equal a logistic regression with C = 1 and a ridge with alpha = 1."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def scaler(rows: DataFrame, vector: str) -> DataFrame:
    """(k, m, s): population mean and deviation of each of the vector's numbers; as many rows as it is long."""
    return rows.select(F.posexplode(vector).alias("k", "x")).groupBy("k").agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("s"))


def with_scaler(rows: DataFrame, vector: str, fitted: DataFrame) -> DataFrame:
    """Adds features: the vector standardised by what scaler() gave (numbers without any deviation are only centred)."""
    one = fitted.agg(F.sort_array(F.collect_list(F.struct("k", "m", "s"))).alias("__z"))  # one row of the vector's length
    df = rows.crossJoin(F.broadcast(one))
    return df.withColumn("features", array_to_vector(F.expr(f"zip_with({vector}, __z, (x, z) -> (x - z.m) / IF(z.s > 0, z.s, 1D))"))).drop("__z")


def scaled(rows: DataFrame, vector: str, fitted: DataFrame | None = None) -> DataFrame:
    """Adds features, standardised by the fitted rows (by the rows themselves without any)."""
    return with_scaler(rows, vector, scaler(rows if fitted is None else fitted, vector))


def direction_model(rows: DataFrame, label: str = "y_dir", balanced: bool = False) -> PipelineModel:
    """Logistic regression on features; balanced: each class has the same weight."""
    counts = {r[label]: r["n"] for r in rows.groupBy(label).agg(F.count(F.lit(1)).alias("n")).collect()}
    n = sum(counts.values())
    weight = F.lit(1.0)
    if balanced:
        weight = F.coalesce(*[F.when(F.col(label) == k, n / (len(counts) * c)) for k, c in counts.items()])
    lr = LogisticRegression(featuresCol="features", labelCol=label, weightCol="__w", regParam=1.0 / n, elasticNetParam=0.0, standardization=False, maxIter=2000, tol=1e-10)
    return Pipeline(stages=[lr]).fit(rows.withColumn("__w", weight))


def return_model(rows: DataFrame, label: str = "y_return") -> PipelineModel:
    """Ridge regression; the label's deviation enters, as Spark scales labels itself."""
    n, s = rows.agg(F.count(F.lit(1)), F.stddev_pop(label)).first()
    lr = LinearRegression(featuresCol="features", labelCol=label, regParam=(s or 1.0) / n, elasticNetParam=0.0, standardization=False, solver="normal")
    return Pipeline(stages=[lr]).fit(rows)


def probability(model: PipelineModel, rows: DataFrame) -> DataFrame:
    return model.transform(rows.withColumn("__w", F.lit(1.0))).withColumn("p", vector_to_array("probability")[1]).drop("rawPrediction", "probability", "prediction", "__w")


def assembler(columns: list[str]) -> VectorAssembler:
    return VectorAssembler(inputCols=columns, outputCol="features")


def saved(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)
