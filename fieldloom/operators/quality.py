"""Constraint checks, as rows that say what is wrong and where."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldloom.operators.scans import numbered

ISSUE = "severity string, manifest string, location string, message string"


def issues(df: DataFrame, manifest: str, location: Column, rules: Sequence[tuple[str, Column, Column | str]]) -> DataFrame:
    """A row for each rule (severity, condition, message) that a row of `df` breaks, in one pass. Conditions give a rule's
    number only, so that texts are made for what is broken, and the code of many rules stays small enough to be compiled."""
    broken = F.explode(F.array(*[F.when(bad, F.lit(k)) for k, (_, bad, _) in enumerate(rules)]))
    found = df.select("*", broken.alias("__rule")).where(F.col("__rule").isNotNull())
    rule = F.col("__rule")
    severity = F.get(F.array(*[F.lit(severity) for severity, _, _ in rules]), rule)
    fixed = F.get(F.array(*[F.lit(text if isinstance(text, str) else None).cast("string") for _, _, text in rules]), rule)
    message = F.coalesce(*[F.when(rule == k, text) for k, (_, _, text) in enumerate(rules) if not isinstance(text, str)], fixed)
    return found.select(severity.alias("severity"), F.lit(manifest).alias("manifest"), location.alias("location"), message.alias("message"))


def union_issues(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def issue_counts(found: DataFrame) -> DataFrame:
    """One row: error_count, warning_count, info_count and the exit status, 1 with errors."""
    n = lambda s: F.count_if(F.col("severity") == s)
    return found.agg(n("error").alias("error_count"), n("warning").alias("warning_count"), n("info").alias("info_count"), (n("error") > 0).cast("int").alias("status"))


def duplicates(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def differences(expected: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """(kind, key): keys that are missing, and keys that aren't expected."""
    a, b = expected.select(key).distinct(), found.select(key).distinct()
    missing = a.join(b, key, "left_anti").select(F.lit("missing").alias("kind"), key)
    return missing.unionAll(b.join(a, key, "left_anti").select(F.lit("unexpected").alias("kind"), key))


def wrong_counts(df: DataFrame, keys: Sequence[str], expected: int) -> DataFrame:
    """(keys, n) of the groups that haven't the expected number of rows."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") != expected)


def not_increasing(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str) -> DataFrame:
    """The rows whose value isn't larger than that of the row before."""
    out = numbered(df, keys, order, "__seen", {"previous": value}).drop("__seen")
    return out.where(F.col("previous").isNotNull() & (F.col(value) <= F.col("previous")))


def required(df: DataFrame, columns: Sequence[str]) -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")


def not_empty(df: DataFrame, what: str) -> DataFrame:
    if df.isEmpty():
        raise ValueError(f"{what} has no rows")
    return df


def different_positions(a: DataFrame, b: DataFrame, keys: Sequence[str], position: str, value: str) -> DataFrame:
    """(keys, position, left, right) where two ordered lists differ, places that only one of them has included."""
    on = [*keys, position]
    both = a.select(*on, F.col(value).alias("left")).join(b.select(*on, F.col(value).alias("right")), on, "full")
    return both.where(~F.col("left").eqNullSafe(F.col("right")))


def scene_problems(scenes: DataFrame, expected: DataFrame, listing: DataFrame) -> DataFrame:
    """(frame_id, problem, detail) of scene documents (frame_id, xml): another number of shapes than in `expected`
    (frame_id, n_expected), and files they name that the listing (path) lacks, each once."""
    found = scenes.select("frame_id", F.xpath_int("xml", F.lit("count(//shape)")).alias("n"), F.xpath("xml", F.lit("//shape/string[@name='filename']/@value")).alias("files"))
    counted = found.join(expected, "frame_id").where(F.col("n") != F.col("n_expected"))
    counted = counted.select("frame_id", F.lit("number of shapes").alias("problem"), F.concat_ws(" instead of ", F.col("n").cast("string"), F.col("n_expected").cast("string")).alias("detail"))
    files = found.select("frame_id", F.explode("files").alias("path")).distinct().join(listing.select("path").distinct(), "path", "left_anti")
    return counted.unionAll(files.select("frame_id", F.lit("file is missing"), F.col("path")))
