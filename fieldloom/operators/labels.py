"""Change labels of link measurements: a row against the row before it of the same receiver."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldloom.operators.scans import numbered

LABELS = (
    "y_path_change",
    "y_path_drop",
    "y_rx_power_drop_0p5db",
    "y_rx_power_drop_1db",
    "y_rx_power_drop_2db",
    "y_delay_spread_increase",
    "y_adaptation_trigger_1db",
    "y_adaptation_trigger_2db",
)


def successful(df: DataFrame, flag: str = "sanity_ok", order: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """Rows whose flag is true, and a preview of the first five of the others by `order` (default: all columns)."""
    good = F.coalesce(F.col(flag), F.lit(False))
    return df.where(good), df.where(~good).orderBy(*(order or df.columns)).limit(5)


def spread_threshold(df: DataFrame, value: str, factor: float = 0.25) -> DataFrame:
    """One row: `factor` population standard deviations over all rows, first ones of a receiver included."""
    return df.agg((factor * F.coalesce(F.stddev_pop(value), F.lit(0.0))).alias("eta"))


def with_deltas(df: DataFrame, receiver: str, order: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Adds prev_ and delta_ columns; the first row of each receiver goes. A receiver's log is many parts."""
    out = numbered(df, [receiver], order, "__seen", {f"prev_{v}": v for v in values}).where("__seen > 0").drop("__seen")
    return out.withColumns({f"delta_{v}": F.col(v) - F.col(f"prev_{v}") for v in values})


def flag(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False)).cast("int")


def labelled(df: DataFrame, eta: float | None = None) -> DataFrame:
    """The eight labels of link rows (frame_id, source_sample_index, rx_id, num_paths, delay_spread, rx_power_dbm).
    eta: the least increase of delay spread; by default a quarter of its standard deviation."""
    limit = df.sparkSession.range(1).select(F.lit(eta).alias("eta")) if eta is not None else spread_threshold(df, "delay_spread")
    out = with_deltas(df, "rx_id", ["frame_id", "source_sample_index"], ["num_paths", "delay_spread", "rx_power_dbm"])
    out = out.withColumnRenamed("delta_rx_power_dbm", "delta_rx_power_db").crossJoin(F.broadcast(limit))
    paths, spread, power = F.col("delta_num_paths"), F.col("delta_delay_spread") > F.col("eta"), F.col("delta_rx_power_db")
    tests = (paths != 0, paths < 0, power < -0.5, power < -1.0, power < -2.0, spread, (power < -1.0) | spread, (power < -2.0) | spread)
    return out.withColumns({n: flag(t) for n, t in zip(LABELS, tests, strict=True)}).drop("eta")


def balance(df: DataFrame, labels: Sequence[str], receiver: str = "rx_id") -> DataFrame:
    """(label, receiver, num_rows, num_positive, positive_ratio) for each receiver and for ALL, in one shuffle."""
    long = df.select(F.col(receiver).cast("string").alias(receiver), F.inline(F.array(*[F.struct(F.lit(n).alias("label"), F.col(n).alias("y")) for n in labels])))
    sums = long.groupingSets([["label"], ["label", receiver]], "label", receiver).agg(
        F.count(F.lit(1)).alias("num_rows"), F.sum("y").alias("num_positive"), F.grouping(receiver).alias("all_rows")
    )
    who = F.when(F.col("all_rows") == 1, F.lit("ALL")).otherwise(F.col(receiver))
    return sums.select("label", who.alias(receiver), "num_rows", "num_positive", (F.col("num_positive") / F.col("num_rows")).alias("positive_ratio"))


def receiver_summary(df: DataFrame, receiver: str, values: Sequence[str], ok: Column) -> DataFrame:
    """Rows, successful rows, and min, mean and max of each value over the successful ones."""
    over = [f(F.when(ok, F.col(v))).alias(f"{n}_{v}") for v in values for n, f in (("min", F.min), ("mean", F.avg), ("max", F.max))]
    return df.groupBy(receiver).agg(F.count(F.lit(1)).alias("num_rows"), F.count_if(ok).alias("num_ok"), *over)
