"""Motion logs: text with one `pose { ... }` block after another, as pose rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.functions.strings import scoped_parts


def _number(body: Column, name: str) -> Column:
    """A number of a block's part; those that are left out are 0."""
    text = F.regexp_extract(body, rf"(?m)^\s*{name}:\s*(\S+)", 1)
    return F.when(text == "", F.lit(0.0)).otherwise(text.try_cast("double"))


def _part(block: Column, name: str) -> Column:
    return F.regexp_extract(block, rf"(?s)\b{name}\s*\{{([^}}]*)\}}", 1)


def _header(block: Column) -> Column:
    """The header's data as a map; of a key that comes again the last value counts."""
    found = [F.regexp_extract_all(block, F.lit(r'key:\s*"([^"]*)"\s*value:\s*"([^"]*)"'), F.lit(k)) for k in (1, 2)]
    keys = F.array_distinct(found[0])
    last = lambda k: F.element_at(F.filter(F.arrays_zip(found[0].alias("k"), found[1].alias("v")), lambda e: e["k"] == k), -1)["v"]
    return F.map_from_arrays(keys, F.transform(keys, last))


def parsed_blocks(blocks: DataFrame, block: str = "value") -> DataFrame:
    """Adds model, link, sec, nsec, header, at array(3), orientation array(4) and error (the first thing that is
    wrong, null if nothing is) to rows that hold the text between one `pose {` and the next."""
    b = F.col(block)
    count = lambda c: F.length(b) - F.length(F.replace(b, F.lit(c), F.lit("")))
    name = scoped_parts(F.regexp_extract(b, r'(?m)^\s*name:\s*"([^"]*)"', 1))
    out = blocks.withColumns(
        {
            "__name": name,
            "sec": _number(_part(b, "stamp"), "sec").cast("long"),
            "nsec": _number(_part(b, "stamp"), "nsec").cast("int"),
            "header": _header(b),
            "at": F.array(*[_number(_part(b, "position"), a) for a in "xyz"]),
            "orientation": F.array(*[_number(_part(b, "orientation"), a) for a in "xyzw"]),
        }
    )
    size = F.aggregate("orientation", F.lit(0.0), lambda s, v: s + v * v)
    child = F.try_element_at("header", F.lit("child_frame_id"))
    problems = [
        (count("{") + 1 != count("}"), "braces don't match"),
        (F.col("__name").isNull(), "name isn't model::link"),
        (child.isNotNull() & (child != F.concat_ws("::", "__name.scope", "__name.name")), "header and name differ"),
        (F.exists(F.concat("at", "orientation"), lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))), "a number isn't finite"),
        (size == 0, "orientation has no length"),
    ]
    error = F.coalesce(*[F.when(bad, F.lit(text)) for bad, text in problems])
    return out.withColumns({"model": F.col("__name.scope"), "link": F.col("__name.name"), "error": error}).drop("__name", block)


def read_pose_log(spark: SparkSession, path: str) -> DataFrame:
    """Pose rows of a log, or of several, with position, a struct that orders the rows of a file. The text is split
    at `pose {` by the reader, so one large file is read by many tasks."""
    raw = spark.read.option("lineSep", "pose {").text(path)
    place = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))
    blocks = raw.select("value", place.alias("position")).where(F.trim(F.regexp_replace("value", r"\s+", "")) != "")
    return parsed_blocks(blocks)


def stream_pose_log(spark: SparkSession, folder: str) -> DataFrame:
    """The same rows of files that arrive in a folder, as a stream."""
    raw = spark.readStream.option("lineSep", "pose {").option("maxFilesPerTrigger", 1).text(folder)
    return parsed_blocks(raw.where(F.trim(F.regexp_replace("value", r"\s+", "")) != ""))
