"""Tables that cut lineage, written to the folder that all executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

#: Only where the session names no folder, as in tests.
FALLBACK_DIR = "/tmp/checkpoints"
BATCH_BYTES = "64m"


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a local session that has none gets a fallback, any other is refused."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        spark.conf.set("spark.checkpoint.dir", found := FALLBACK_DIR)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def staged(df: DataFrame, name: str, batch_rows: int | None = None) -> DataFrame:
    """Writes `df` as a Parquet table of its own in the shared folder and reads it back: later jobs start
    from the files, also when an executor is lost. batch_rows: rows of an Arrow batch while it is written, for
    wide rows, which then has BATCH_BYTES at most too; the session's settings are put back."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/staged/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    own = {"maxRecordsPerBatch": str(batch_rows), "maxBytesPerBatch": BATCH_BYTES} if batch_rows else {}
    before = {k: spark.conf.get(f"spark.sql.execution.arrow.{k}") for k in own}
    for k, v in own.items():
        spark.conf.set(f"spark.sql.execution.arrow.{k}", v)
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.set(f"spark.sql.execution.arrow.{k}", v)
    return spark.read.schema(df.schema).parquet(path)
