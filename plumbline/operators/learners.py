"""Out-of-fold predictions of Spark ML models: linear, boosted trees, logistic."""

from __future__ import annotations

from functools import reduce

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.sources.staging import staged


def model(kind: str, label: str, rows: int):
    """The estimator of a kind; logistic penalties follow a unit inverse strength over all rows."""
    common = {"featuresCol": "_features", "labelCol": label, "predictionCol": "_prediction"}
    if kind == "linear":
        return LinearRegression(**common)
    if kind == "boosted":
        return GBTRegressor(**common, maxIter=40, maxDepth=3, stepSize=0.1, subsamplingRate=0.9, seed=7, maxBins=32)
    if kind == "logistic":
        return LogisticRegression(**common, regParam=1.0 / max(rows, 1), probabilityCol="_probability")
    raise ValueError(f"unknown kind of model: {kind}")


def out_of_fold(df: DataFrame, features: list[str], label: str, fold: str, kind: str, name: str = "predicted") -> DataFrame:
    """df's usable rows with a prediction of each by a model that hasn't seen its fold. Folds are few."""
    rows = VectorAssembler(inputCols=features, outputCol="_features", handleInvalid="skip").transform(df.dropna(subset=[*features, label]))
    rows = staged(rows, "learners-rows")
    counts = {r[fold]: r["count"] for r in rows.groupBy(fold).count().collect()}
    if len(counts) < 2:
        raise ValueError("out-of-fold predictions need two folds at least")
    parts = []
    for k, n in sorted(counts.items()):
        fitted = model(kind, label, sum(counts.values()) - n).fit(rows.where(F.col(fold) != k))
        out = fitted.transform(rows.where(F.col(fold) == k))
        parts.append(out.withColumn(name, vector_to_array("_probability")[1] if kind == "logistic" else F.col("_prediction")).select(*df.columns, name))
    return reduce(DataFrame.unionByName, parts)


def repeated_out_of_fold(df: DataFrame, key: str, features: list[str], label: str, folds: list[str], kind: str, name: str = "predicted") -> DataFrame:
    """df's usable rows with the mean of their out-of-fold predictions over repeats, one column of folds each. key is unique."""
    each = [out_of_fold(df, features, label, fold, kind, "_p").select(F.col(key).alias("_key"), "_p") for fold in folds]
    mean = reduce(DataFrame.unionByName, each).groupBy("_key").agg(F.avg("_p").alias(name))
    return df.join(mean, F.col(key) == F.col("_key")).drop("_key")
