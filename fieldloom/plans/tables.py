"""Access to the driver's tables. Paths are only ever opened by Spark's readers."""

from pyspark.sql import DataFrame, SparkSession

from fieldloom.plans.shipping import ship_package


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table `name` under `sf_dir` (a file or a folder, in any store that Spark reads)."""
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
