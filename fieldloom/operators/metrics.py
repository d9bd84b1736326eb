"""Classification metrics, baselines and weights over folds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldloom.operators.scans import numbered

METRICS = ("accuracy", "balanced_accuracy", "precision", "recall", "f1")


def confusion_metrics(df: DataFrame, keys: Sequence[str], truth: str = "y", guess: str = "y_pred") -> DataFrame:
    """The five metrics of each key; 0 where a denominator is 0."""
    y, p = F.col(truth) == 1, F.col(guess) == 1
    counts = df.groupBy(*keys).agg(F.count_if(y & p).alias("tp"), F.count_if(~y & p).alias("fp"), F.count_if(y & ~p).alias("fn"), F.count_if(~y & ~p).alias("tn"))
    ratio = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))
    tp, fp, fn, tn = map(F.col, ("tp", "fp", "fn", "tn"))
    precision, recall, other = ratio(tp, tp + fp), ratio(tp, tp + fn), ratio(tn, tn + fp)
    values = (ratio(tp + tn, tp + fp + fn + tn), (recall + other) / 2, precision, recall, ratio(2 * precision * recall, precision + recall))
    return counts.select(*keys, *[v.alias(n) for n, v in zip(METRICS, values, strict=True)])


def over_folds(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Mean and population standard deviation of each metric."""
    each = [f(m).alias(f"{m}_{n}") for m in METRICS for n, f in (("mean", F.avg), ("std", F.stddev_pop))]
    return df.groupBy(*keys).agg(*each)


def majority_predictions(df: DataFrame, fold: str = "fold", truth: str = "y") -> DataFrame:
    """Adds y_pred: the majority (ties: 1) over the rows of all other folds, from one pass of fold sums."""
    sums = df.groupBy(fold).agg(F.sum(truth).alias("s"), F.count(F.lit(1)).alias("n"))
    total = sums.agg(F.sum("s").alias("all_s"), F.sum("n").alias("all_n"))
    rest = sums.crossJoin(F.broadcast(total)).select(fold, (F.try_divide(F.col("all_s") - F.col("s"), F.col("all_n") - F.col("n")) >= 0.5).cast("int").alias("y_pred"))
    return df.join(F.broadcast(rest), fold)


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """(label, n, weight): n_all / (classes * n_class)."""
    counts = df.where(F.col(label).isNotNull()).groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("all_n"), F.count(F.lit(1)).alias("classes"))
    return counts.crossJoin(F.broadcast(total)).select(label, "n", (F.col("all_n") / (F.col("classes") * F.col("n"))).alias("weight"))


def constant_target(df: DataFrame, label: str) -> Column | bool:
    """Whether the target has fewer than two values, so nothing can be learned."""
    return df.select(label).where(F.col(label).isNotNull()).distinct().limit(2).count() < 2


def ranked_folds(df: DataFrame, group: str) -> DataFrame:
    """Rows per group with their place from the largest group to the smallest."""
    sizes = df.groupBy(group).agg(F.count(F.lit(1)).alias("n"))
    out = numbered(sizes.withColumn("__less", -F.col("n")), [], ["__less", group], "place")
    return out.select(group, "n", (F.col("place") + 1).cast("int").alias("place"))
