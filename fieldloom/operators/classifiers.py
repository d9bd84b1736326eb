"""Classifiers for the ablation's folds, those of Spark ML and the perceptron."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline
from pyspark.ml.classification import LinearSVC, RandomForestClassifier
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.operators.perceptron import perceptron_predictions

MODELS = ("random_forest", "rbf_svm", "mlp")


def feature_vectors(df: DataFrame, features: Sequence[str], out: str = "features") -> DataFrame:
    """Adds a dense vector of the features; missing values are 0."""
    filled = df.fillna(0.0, subset=list(features))
    return VectorAssembler(inputCols=list(features), outputCol=out).transform(filled)


def fourier_features(df: DataFrame, source: str, size: int, n: int = 256, seed: int = 5) -> DataFrame:
    """Random Fourier features of an RBF kernel with gamma 1 / size over standardised vectors: their products come
    near the kernel's values, so a linear machine over them comes near the kernel machine."""
    rng = np.random.default_rng(seed)
    w, b = rng.standard_normal((n, size)) * math.sqrt(2 / size), rng.uniform(0, 2 * math.pi, n)

    @F.pandas_udf("array<double>")
    def waves(x: pd.Series) -> pd.Series:
        return pd.Series(list(np.cos(np.array(x.tolist()).reshape(-1, size) @ w.T + b) * math.sqrt(2 / n)))

    return df.withColumn("fourier", array_to_vector(waves(vector_to_array(source))))


def predictions(df: DataFrame, features: Sequence[str], model: str, target: str = "y", fold: str = "fold", trees: int = 300, seed: int = 1000) -> DataFrame:
    """(fold, y, y_pred) of every row by a model learned from the other folds' rows, which are weighted by
    n / (2 n_class). One Spark ML fit for each fold, but for `mlp`, whose folds learn together; folds are few. No rows
    give none."""
    if model not in MODELS:
        raise ValueError(f"unknown model {model}")
    if model == "mlp":
        return perceptron_predictions(df, features, target, fold, seed)
    rows = feature_vectors(df.where(F.col(target).isNotNull()), features, "raw").select(F.col(fold).alias("fold"), F.col(target).cast("double").alias("y"), "raw")
    parts = []
    for k in [r[0] for r in rows.select("fold").distinct().orderBy("fold").collect()]:
        train, test = rows.where(F.col("fold") != k), rows.where(F.col("fold") == k)
        counts = {r.y: r.n for r in train.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
        if len(counts) < 2:
            parts.append(test.select("fold", F.col("y").cast("int").alias("y"), F.lit(int(next(iter(counts), 0))).alias("y_pred")))
            continue
        total = sum(counts.values())
        weight = F.when(F.col("y") == 1, total / (2 * counts[1.0])).otherwise(total / (2 * counts[0.0]))
        scaler = StandardScaler(inputCol="raw", outputCol="features", withMean=True).fit(train)
        train, test = scaler.transform(train).withColumn("w", weight), scaler.transform(test)
        if model == "random_forest":
            learner = RandomForestClassifier(labelCol="y", weightCol="w", numTrees=trees, minInstancesPerNode=3, seed=seed + int(k))
        else:
            train, test = (fourier_features(d, "features", len(features)) for d in (train, test))
            learner = LinearSVC(labelCol="y", weightCol="w", featuresCol="fourier", regParam=1.0 / total)
        train = train.select("y", "w", learner.getFeaturesCol()).cache()
        fitted = Pipeline(stages=[learner]).fit(train)
        train.unpersist()
        parts.append(fitted.transform(test).select("fold", F.col("y").cast("int").alias("y"), F.col("prediction").cast("int").alias("y_pred")))
    return reduce(DataFrame.unionAll, parts) if parts else df.sparkSession.createDataFrame([], "fold int, y int, y_pred int")
