"""Radio rows: paths to link powers, and solvers as plug-ins."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from typing import Any

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldloom.functions.geometry import decibels
from fieldloom.operators.rounds import settled

LINK = "frame_id int, rx_id string, tx_power_dbm double, num_paths int, tau_min double, tau_max double, delay_spread double, path_gain_sum double, path_gain_db double, rx_power_dbm double"


def usable(path: Mapping[str, Column] | None = None) -> Column:
    """Paths that are marked valid; where the mark is missing, those with a finite delay that isn't negative."""
    valid, tau = (path or {}).get("valid", F.col("valid")), (path or {}).get("tau", F.col("tau"))
    return F.coalesce(valid, tau.isNotNull() & ~F.isnan(tau) & (tau >= 0) & (tau != float("inf")))


def link_power(paths: DataFrame) -> DataFrame:
    """Per frame and receiver, from paths (frame_id, rx_id, tx_power_dbm, tau, re, im, valid): how many, the least and
    largest delay and their difference, the summed power of the amplitudes, and it in dB and dBm. A link without a
    usable path has no delays and the power of no signal."""
    ok = usable()
    power = F.coalesce(F.sum(F.when(ok, F.col("re") * F.col("re") + F.col("im") * F.col("im"))), F.lit(0.0))
    sums = paths.groupBy("frame_id", "rx_id").agg(F.max("tx_power_dbm").alias("tx_power_dbm"), F.count_if(ok).cast("int").alias("num_paths"), F.min(F.when(ok, F.col("tau"))).alias("tau_min"), F.max(F.when(ok, F.col("tau"))).alias("tau_max"), power.alias("path_gain_sum"))
    db = decibels(F.col("path_gain_sum"))
    return sums.select("frame_id", "rx_id", "tx_power_dbm", "num_paths", "tau_min", "tau_max", (F.col("tau_max") - F.col("tau_min")).alias("delay_spread"), "path_gain_sum", db.alias("path_gain_db"), (F.col("tx_power_dbm") + db).alias("rx_power_dbm"))


def solved(links: DataFrame, solve: Callable[[Mapping[str, Any]], Mapping[str, Any]], schema: str, partitions: int | None = None) -> DataFrame:
    """Each link with what `solve(link)` gives for it (columns of `schema`), sanity_ok and error_message. A solver's
    error is a row, not the end of the job, so what is done stays and the rest goes on. Solving is slow, so links are
    dealt out evenly first if `partitions` is given."""
    extra = T.StructType.fromDDL(schema)
    whole = T.StructType([*links.schema.fields, *extra.fields, T.StructField("sanity_ok", T.BooleanType()), T.StructField("error_message", T.StringType())])
    names, wanted = whole.names, extra.names

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for link in batch.to_dict("records"):
                try:
                    found = solve(link)
                    rows.append({**link, **{n: found[n] for n in wanted}, "sanity_ok": True, "error_message": None})
                except Exception as e:  # a solver may raise anything
                    rows.append({**link, **dict.fromkeys(wanted), "sanity_ok": False, "error_message": f"{type(e).__name__}: {e}"})
            yield pd.DataFrame(rows, columns=names)

    dealt = links.repartition(partitions) if partitions else links
    return dealt.mapInPandas(run, whole)


class UnsolvedLinks(RuntimeError):
    """Some links of a part couldn't be solved; what was solved is kept."""


def _committed(spark: SparkSession, folder: str, schema: T.StructType) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(folder)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def solved_rows(spark: SparkSession, folder: str, schema: T.StructType, keys: Sequence[str]) -> DataFrame:
    """The rows that `solve_in_parts` has kept in `folder`: of each link the one that is solved, or the last error."""
    rows = _committed(spark, folder, schema)
    best = F.max_by(F.struct(*[c for c in schema.names if c not in (*keys, "attempt")]), F.struct("sanity_ok", "attempt"))
    return rows.groupBy(*keys).agg(best.alias("__best")).select(*keys, "__best.*")


def solve_in_parts(
    links: DataFrame, solve: Callable[[Mapping[str, Any]], Mapping[str, Any]], schema: str, folder: str, keys: Sequence[str] = ("frame_id", "rx_id"), parts: int = 16, partitions: int | None = None, go_on: bool = False
) -> DataFrame:
    """`solved`, part by part: the rows of a part are committed to `folder` before the next one begins, so a run that stops
    or fails keeps all parts before, and another run with the same folder solves only what is left, errors too. After a part in
    which a link couldn't be solved UnsolvedLinks is raised, its rows being kept, unless told to `go_on`. Gives the rows of all
    runs, one for each link. keys: what names a link; none may be null.
    """
    spark = links.sparkSession
    whole = solved(links.limit(0), solve, schema).schema
    kept = T.StructType([*whole.fields, T.StructField("attempt", T.IntegerType())])
    before = _committed(spark, folder, kept)
    attempt = (before.agg(F.max("attempt")).first()[0] or 0) + 1
    part = F.pmod(F.xxhash64(*keys), F.lit(parts))
    left = settled(links.join(before.where("sanity_ok").select(*keys), list(keys), "left_anti").withColumn("__part", part), "unsolved")
    for k in range(parts):
        some = left.where(F.col("__part") == k).drop("__part")
        if some.isEmpty():
            continue
        solved(some, solve, schema, partitions).withColumn("attempt", F.lit(attempt)).write.mode("append").parquet(folder)
        if not go_on:
            bad = _committed(spark, folder, kept).where((F.col("attempt") == attempt) & ~F.col("sanity_ok"))
            first = bad.select(*keys, "error_message").orderBy(*keys).limit(3).collect()
            if first:
                raise UnsolvedLinks("; ".join(f"{tuple(r)[:-1]}: {r.error_message}" for r in first))
    return solved_rows(spark, folder, kept, keys)


def recorded(links: DataFrame, rows: DataFrame) -> DataFrame:
    """The default solver: rows that were solved before, by frame and receiver; links without one aren't ok."""
    found = rows.drop("sanity_ok", "error_message").withColumn("__found", F.lit(True))
    out = links.join(found, ["frame_id", "rx_id"], "left").withColumn("sanity_ok", F.coalesce("__found", F.lit(False)))
    return out.withColumn("error_message", F.when(~F.col("sanity_ok"), F.lit("no recorded row"))).drop("__found")


def checked_lookup(rows: DataFrame, index: DataFrame, key: str, second: str) -> tuple[DataFrame, DataFrame]:
    """Rows with their index entry, and what is wrong: keys that the index lacks, and entries whose second key is
    another."""
    found = rows.join(index.withColumnRenamed(second, "__second"), key, "left")
    known = index.select(key).distinct()
    missing = rows.join(known, key, "left_anti").select(F.col(key).cast("string").alias("key"), F.lit("not in the index").alias("problem"))
    other = found.where(F.col("__second").isNotNull() & (F.col("__second") != F.col(second))).select(F.col(key).cast("string").alias("key"), F.lit(f"another {second}").alias("problem"))
    return found.where(F.col("__second") == F.col(second)).drop("__second"), missing.unionAll(other)
