"""Deterministic samples and splits."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldloom.functions.geometry import half_up
from fieldloom.operators.scans import numbered


def uniform_samples(counts: DataFrame, n: int) -> DataFrame:
    """(frame_id, source_sample_index): n indices spread over the samples that all models have; the first and the
    last are pinned. counts: (n_samples), a row per model."""
    if n < 2:
        raise ValueError("at least two samples")
    common = counts.agg(F.min("n_samples").cast("long").alias("common"))
    frames = counts.sparkSession.range(n).select(F.col("id").cast("int").alias("frame_id")).crossJoin(F.broadcast(common))
    last = F.col("common") - 1
    enough = F.when(F.col("common") >= n, half_up(F.col("frame_id") * last, F.lit(n - 1))).otherwise(F.raise_error(F.lit("more samples asked for than there are")).cast("long"))
    return frames.select("frame_id", enough.alias("source_sample_index"))


def hash_subsample(df: DataFrame, keys: Sequence[str], hashed: Column, ties: Sequence[str], n: int) -> DataFrame:
    """At most n rows of each key, those with the smallest hash: the same ones however the rows are dealt out."""
    w = Window.partitionBy(*keys).orderBy(hashed, *ties)
    return df.withColumn("__rank", F.row_number().over(w)).where(F.col("__rank") <= n).drop("__rank")


def _filled(value: np.ndarray, size: np.ndarray, load: np.ndarray) -> np.ndarray:
    """How many groups of a size the folds have taken while they were not above a value."""
    return np.maximum(0, (value[:, None] - load) // size[:, None] + 1).sum(axis=1)


def _turns(turn: np.ndarray, size: np.ndarray, load: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(fold, its rows so far) of the groups with the given turns among groups of equal size, if each goes to the fold
    with the fewest rows, the first on ties: folds then take turns in the order of load + j * size, j = 0, 1, ..."""
    low = load.min(axis=1)
    high = low + turn * size
    while (low < high).any():
        middle = (low + high) // 2
        enough = _filled(middle, size, load) > turn
        low, high = np.where(enough, low, middle + 1), np.where(enough, middle, high)
    rest = turn - _filled(low - 1, size, load)
    level = (load <= low[:, None]) & ((low[:, None] - load) % size[:, None] == 0)
    return (np.cumsum(level, axis=1) > rest[:, None]).argmax(axis=1), low


def _loads_after(count: int, size: int, load: list[int]) -> list[int]:
    """The folds' rows when `count` groups of a size are dealt out."""
    fold, level = (int(v[0]) for v in _turns(np.array([count - 1]), np.array([size]), np.array([load])))
    return [x + size * max(0, (level - x) // size + (i <= fold or (level - x) % size > 0)) for i, x in enumerate(load)]


def group_folds(df: DataFrame, group: str, k: int) -> DataFrame:
    """(group, n, fold): groups from the largest to the smallest (ties by group), each to the fold with the fewest
    rows so far (ties to the first). Groups of equal size are dealt out by their place among them, so the driver sees
    only how many there are of each size: at most the root of twice the rows of `df`."""
    spark = df.sparkSession
    sizes = numbered(df.groupBy(group).agg(F.count(F.lit(1)).alias("n")), ["n"], [group], "__place")
    found = sorted(map(tuple, sizes.groupBy("n").count().collect()), reverse=True)
    groups = sum(n for _, n in found)
    if not 2 <= k <= groups:
        raise ValueError(f"{k} folds of {groups} groups")
    load, starts = [0] * k, []
    for size, n in found:
        starts.append((size, list(load)))
        load = _loads_after(n, size, load)
    start = spark.createDataFrame(starts, "n long, __load array<long>")

    @F.pandas_udf("int")
    def fold(turn: pd.Series, size: pd.Series, load: pd.Series) -> pd.Series:
        return pd.Series(_turns(turn.to_numpy(), size.to_numpy(), np.stack(load.to_numpy()))[0] if len(turn) else [], dtype="int32")

    return sizes.join(start, "n").select(group, "n", fold("__place", "n", "__load").alias("fold"))
