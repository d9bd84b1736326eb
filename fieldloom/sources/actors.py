"""Animated figures: their definition in a world, and the animation document's facts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.functions.strings import numeric_list
from fieldloom.operators.frames import tolerance_lookup

ACTOR_XML = (
    "_name string, skin struct<filename:string,scale:double>, animation array<struct<_name:string,filename:string,interpolate_x:boolean>>,"
    " script struct<loop:boolean,delay_start:double,auto_start:boolean,trajectory:array<struct<_id:int,_type:string,waypoint:array<struct<time:double,pose:string>>>>>"
)


def read_actors(spark: SparkSession, path: str) -> DataFrame:
    """(actor, skin, scale, animations, loop, trajectories) of the `<actor>` elements."""
    rows = spark.read.format("xml").option("rowTag", "actor").schema(ACTOR_XML).load(path)
    return rows.select(F.col("_name").alias("actor"), F.col("skin.filename").alias("skin"), F.coalesce("skin.scale", F.lit(1.0)).alias("scale"), "animation", F.col("script.loop").alias("loop"), F.col("script.trajectory").alias("trajectories"))


def waypoints(actors: DataFrame) -> DataFrame:
    """(actor, trajectory, waypoint, time, pose array(6)), numbered from 0."""
    rows = actors.select("actor", F.posexplode("trajectories").alias("trajectory", "t"))
    return rows.select("actor", "trajectory", F.posexplode("t.waypoint").alias("waypoint", "w")).select("actor", "trajectory", "waypoint", "w.time", numeric_list(F.col("w.pose"), 6).alias("pose"))


def poses_at(points: DataFrame, times: DataFrame, tolerance: float = 1e-9) -> DataFrame:
    """The waypoints at given times (column at), equal up to a tolerance."""
    return tolerance_lookup(times, points, "at", "time", tolerance)


def sub_frames(seconds: Column, fps: int) -> Column:
    """struct(frame, fraction) of a time at so many frames a second."""
    place = seconds * fps
    return F.struct(F.floor(place).cast("long").alias("frame"), (place - F.floor(place)).alias("fraction"))


def animation_facts(documents: DataFrame) -> DataFrame:
    """(path, joints, n_keyframes, first_time, last_time, n_controllers) of COLLADA texts (path, value)."""
    words = lambda p: F.filter(F.split(F.trim(F.array_join(F.xpath("value", F.lit(p)), " ")), r"\s+"), lambda w: w != "")
    times = F.transform(words("//animation//source[contains(@id, 'input')]/float_array/text()"), lambda w: w.try_cast("double"))
    rows = documents.select("path", words("//skin//Name_array/text()").alias("joints"), times.alias("times"), F.xpath_int("value", F.lit("count(//controller)")).alias("n_controllers"))
    return rows.select("path", "joints", F.size("times").alias("n_keyframes"), F.array_min("times").alias("first_time"), F.array_max("times").alias("last_time"), "n_controllers")


def report(facts: DataFrame) -> DataFrame:
    """(path, markdown): a short report of each document."""
    line = lambda name, v: F.concat(F.lit(f"- {name}: "), F.coalesce(v.cast("string"), F.lit("none")))
    lines = [F.concat(F.lit("# "), "path"), line("joints", F.size("joints")), line("keyframes", F.col("n_keyframes")), line("first time", F.col("first_time")), line("last time", F.col("last_time")), line("controllers", F.col("n_controllers"))]
    return facts.select("path", F.array_join(F.array(*lines), "\n").alias("markdown"))
