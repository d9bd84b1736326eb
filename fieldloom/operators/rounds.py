"""Tables between the steps of an operator, written to the folder that all executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

#: Only for local sessions that name no folder, as in tests.
FALLBACK_DIR = "/tmp/checkpoints"


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a local session that has none gets a fallback, any other is refused."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        spark.conf.set("spark.checkpoint.dir", found := FALLBACK_DIR)
    return found.rstrip("/")


def settled(df: DataFrame, name: str = "round") -> DataFrame:
    """`df` as a Parquet table below spark.checkpoint.dir: its lineage ends there, and an executor that is lost takes
    nothing with it. The table stays until the folder is cleared."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/settled/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
