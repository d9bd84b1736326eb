"""The tables as streams, run over what is there."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.plans.tables import table
from fieldloom.streaming import stateful


def _folder(spark: SparkSession, name: str) -> str:
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "/tmp/checkpoints"
    return f"{base.rstrip('/')}/streams/{name}-{uuid.uuid4().hex}"


def _stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    schema = table(spark, sf_dir, name).schema
    path = f"{sf_dir}/{name}.parquet"
    return spark.readStream.schema(schema).parquet(path + "*")


def conversation_samples(spark: SparkSession, sf_dir: str, roles: Sequence[str]) -> DataFrame:
    turns = _stream(spark, sf_dir, "conversations").where("role <> 'system'")
    poses = turns.select(F.col("conv_id").cast("string").alias("model"), F.col("turn").alias("position"), F.col("role").alias("link"))
    out = stateful.assemble_samples(poses, {"*": roles})
    return stateful.run_available(out, _folder(spark, "samples")).where("accepted").drop("accepted")


def event_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _stream(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("receiver"), F.col("event_id").alias("frame"), "value")
    return stateful.run_available(stateful.lag_labels(events), _folder(spark, "labels"))
