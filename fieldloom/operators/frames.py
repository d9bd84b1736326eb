"""Samples of motion logs and what is joined to them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.operators.scans import numbered


def assembled(poses: DataFrame, links: DataFrame) -> DataFrame:
    """Adds sample_index and accepted to pose rows (model, link, position).

    A model's log is a row of complete sets of its links: each link's k-th occurrence is in sample k. A log is
    accepted if that is so for every row: all links are expected, the k-th occurrence stands in the k-th stretch
    of as many rows as the model has links, and nothing is left over. links: (model, link). A log is many parts.
    """
    sizes = links.groupBy("model").agg(F.count(F.lit(1)).alias("__n"))
    expected = links.select("model", "link", F.lit(True).alias("__expected")).join(sizes, "model")
    rows = poses.join(expected, ["model", "link"], "left").join(sizes.select("model", F.col("__n").alias("__links")), "model", "left")
    rows = numbered(numbered(rows, ["model", "link"], ["position"], "sample_index"), ["model"], ["position"], "__row")
    good = F.coalesce(F.col("__expected"), F.lit(False)) & (F.col("sample_index") == F.floor(F.col("__row") / F.col("__links")))
    state = rows.withColumn("__good", F.coalesce(good, F.lit(False))).groupBy("model").agg(F.bool_and("__good").alias("__all"), (F.count(F.lit(1)) % F.max("__links") == 0).alias("__whole"))
    accepted = state.select("model", F.coalesce(F.col("__all") & F.col("__whole"), F.lit(False)).alias("accepted"))
    return rows.drop("__expected", "__n", "__links", "__row").join(accepted, "model")


def selected(samples: DataFrame, frames: DataFrame) -> DataFrame:
    """The rows of the samples that are frames, with frame_id; a sample may be several. frames: (frame_id,
    source_sample_index)."""
    return samples.join(frames.withColumnRenamed("source_sample_index", "sample_index"), "sample_index")


def inconsistent_samples(samples: DataFrame, stamps: Sequence[str]) -> DataFrame:
    """(model, sample_index, n_stamps) of samples whose rows have different time stamps."""
    return samples.groupBy("model", "sample_index").agg(F.count_distinct(F.struct(*stamps)).alias("n_stamps")).where("n_stamps > 1")


def aligned(left: DataFrame, right: DataFrame, ordinal: str, stamps: Sequence[str]) -> DataFrame:
    """Rows of two models with the same ordinal, and whether their stamps agree; columns get _a and _b."""
    a = left.select(ordinal, *[F.col(c).alias(f"{c}_a") for c in left.columns if c != ordinal])
    b = right.select(ordinal, *[F.col(c).alias(f"{c}_b") for c in right.columns if c != ordinal])
    same = F.struct(*[F.col(f"{s}_a") for s in stamps]) == F.struct(*[F.col(f"{s}_b") for s in stamps])
    return a.join(b, ordinal).withColumn("same_stamp", same)


def posed_visuals(poses: DataFrame, visuals: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Each link pose with each of its visuals, and the poses of links without any."""
    keys = ["model", "link"]
    return poses.join(visuals, keys), poses.join(visuals.select(*keys).distinct(), keys, "left_anti")


def cross_frames(frames: DataFrame, receivers: DataFrame, max_frames: int | None = None, max_rows: int | None = None) -> DataFrame:
    """Every frame with every receiver; frames are cut before, rows after, both by (frame_id, rx_id)."""
    clipped = frames.orderBy("frame_id").limit(max_frames) if max_frames is not None else frames
    out = clipped.crossJoin(receivers)
    return out.orderBy("frame_id", "rx_id").limit(max_rows) if max_rows is not None else out


def composed(static: DataFrame, dynamic: DataFrame, frames: DataFrame) -> DataFrame:
    """The static entries in every frame, and each frame's dynamic ones."""
    return frames.crossJoin(static).withColumn("source", F.lit("static")).unionByName(dynamic.withColumn("source", F.lit("dynamic")), allowMissingColumns=True)


def frame_structs(records: DataFrame) -> DataFrame:
    """(frame_id, models): a map from model to a map from link to record."""
    links = records.groupBy("frame_id", "model").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("link", "record")))).alias("links"))
    return links.groupBy("frame_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("model", F.struct(F.col("links").alias("links")))), lambda a, b: F.when(a["model"] < b["model"], -1).when(a["model"] > b["model"], 1).otherwise(0))).alias("models"))


def tolerance_lookup(times: DataFrame, keyed: DataFrame, time: str, at: str, tolerance: float) -> DataFrame:
    """Rows of `keyed` at each time, up to the tolerance. Both sides are joined on buckets twice as wide as the
    tolerance; a key is copied to the bucket on either side, so no pair is missed and none is made twice."""
    width = 2 * tolerance
    left = times.withColumn("__bucket", F.floor(F.col(time) / width))
    right = keyed.withColumn("__bucket", F.explode(F.array(*[F.floor(F.col(at) / width) + k for k in (-1, 0, 1)])))
    return left.join(right, "__bucket").where(F.abs(F.col(time) - F.col(at)) <= tolerance).drop("__bucket")
