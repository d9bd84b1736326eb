"""World and model documents, manifests, link tables and model indexes."""

from __future__ import annotations

import json
import xml.etree.ElementTree as ET
from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldloom.operators.manifests import LINK, MANIFEST
from fieldloom.operators.quality import duplicates, not_empty

MODELS = "file string, place int, model string, model_pose string, static string, links string"
INCLUDE_XML = "name string, uri string, pose string"
NO_POSE = "0 0 0 0 0 0"

LINK_ROWS = T.StructType(
    [T.StructField("frame_id", T.IntegerType()), T.StructField("source_sample_index", T.IntegerType()), T.StructField("rx_id", T.StringType()), T.StructField("xml_path", T.StringType())]
    + [T.StructField(n, T.DoubleType()) for n in ("tx_power_dbm", "tx_x", "tx_y", "tx_z", "rx_x", "rx_y", "rx_z", "frequency_hz")]
    + [T.StructField("num_paths", T.IntegerType())]
    + [T.StructField(n, T.DoubleType()) for n in ("tau_min", "tau_max", "delay_spread", "path_gain_sum", "path_gain_db", "rx_power_dbm")]
    + [T.StructField(n, T.StringType()) for n in ("gain_method", "gain_error", "a_shape", "tau_cir_shape", "valid_shape", "tau_shape", "gain_debug")]
    + [T.StructField("sanity_ok", T.BooleanType()), T.StructField("error_message", T.StringType())]
)


def _text(e: ET.Element, path: str, default: str | None = None) -> str | None:
    found = e.findtext(path)
    return default if found is None else found.strip()


def _matrix(pose: str) -> np.ndarray:
    x, y, z, roll, pitch, yaw = map(float, pose.split())
    (cr, cp, cy), (sr, sp, sy) = np.cos((roll, pitch, yaw)), np.sin((roll, pitch, yaw))
    turn = np.array([[cy, -sy, 0], [sy, cy, 0], [0, 0, 1]]) @ np.array([[cp, 0, sp], [0, 1, 0], [-sp, 0, cp]]) @ np.array([[1, 0, 0], [0, cr, -sr], [0, sr, cr]])
    return np.vstack([np.column_stack([turn, (x, y, z)]), (0, 0, 0, 1)])


def pose_chain(*poses: str) -> str:
    """The pose of the last in the frame that the first is in, with 15 digits; where the pitch is a right angle, all
    turning about one axis counts as roll."""
    m = reduce(np.matmul, map(_matrix, poses))
    flat = float(np.hypot(m[0, 0], m[1, 0]))
    roll, yaw = (np.arctan2(-m[1, 2], m[1, 1]), 0.0) if flat < 1e-9 else (np.arctan2(m[2, 1], m[2, 2]), np.arctan2(m[1, 0], m[0, 0]))
    return " ".join(f"{v + 0.0:.15g}" for v in (*m[:3, 3], roll, np.arctan2(-m[2, 0], flat), yaw))


def _visual(v: ET.Element) -> dict | None:
    """The first of mesh, box, cylinder and sphere that a visual has; none without any."""
    out = {"visual_name": v.get("name"), "visual_pose": _text(v, "pose", NO_POSE)}
    get = lambda path: _text(v, f"geometry/{path}") or None
    if uri := get("mesh/uri"):
        return out | {"geometry_type": "mesh", "uri": uri, "scale": get("mesh/scale") or "1 1 1"}
    if size := get("box/size"):
        return out | {"geometry_type": "box", "size": size}
    if (radius := get("cylinder/radius")) and (length := get("cylinder/length")):
        return out | {"geometry_type": "cylinder", "radius": float(radius), "length": float(length)}
    if radius := get("sphere/radius"):
        return out | {"geometry_type": "sphere", "radius": float(radius)}
    return None


def _links(model: ET.Element, scope: tuple[str, ...] = (), poses: tuple[str, ...] = ()) -> list[dict]:
    """A model's links and those of the models in it, at any depth: named by the scopes inside the outermost model,
    with their pose in it."""
    out = []
    for link in model.findall("link"):
        pose = _text(link, "pose", NO_POSE)
        name = "::".join([*scope, link.get("name")]) if link.get("name") is not None else None
        out.append({"link": name, "link_pose": pose_chain(*poses, pose) if poses else pose, "visuals": [x for v in link.findall("visual") if (x := _visual(v))]})
    for inner in model.findall("model"):
        name = inner.get("name")
        out += _links(inner, (*scope, name) if name else scope, (*poses, _text(inner, "pose", NO_POSE)))
    return out


def _documents(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for file, text in zip(batch["file"], batch["value"], strict=True):
            root = ET.fromstring(text)
            for place, m in enumerate(root.findall("world/model") + root.findall("model")):
                rows.append((file, place, m.get("name"), _text(m, "pose", NO_POSE), _text(m, "static"), json.dumps(_links(m))))
        yield pd.DataFrame(rows, columns=["file", "place", "model", "model_pose", "static", "links"])


def read_models(spark: SparkSession, path: str, static_default: bool = False) -> DataFrame:
    """Manifest rows of the models of world and model documents, in `file` the document and in `place` which of its
    models it is. Links of models inside a model, however deep, are scoped by the names of those, and their poses are
    composed with theirs. A document that is no XML is an error."""
    rows = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value").mapInPandas(_documents, MODELS)
    static = F.when(F.col("static").isNull(), F.lit(static_default)).otherwise(F.lower("static") == "true")
    links = F.from_json("links", T.ArrayType(LINK))
    return rows.select("model", "model_pose", static.alias("static"), F.lit("model").alias("source_type"), F.lit(None).cast("string").alias("source_uri"), links.alias("links"), "file", "place")


def read_includes(spark: SparkSession, world: str, models: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The named `<include>` elements of a world as manifest rows, by the model that their uri names, and the named
    ones whose uri names none; includes without a name or uri are left out. models: what `read_models` gives for the
    model documents, with static_default=True: whether an include is static is said in its model, which is the first
    of its document."""
    includes = spark.read.format("xml").option("rowTag", "include").schema(INCLUDE_XML).load(world)
    includes = includes.where((F.trim("name") != "") & (F.trim("uri") != "")).withColumn("key", F.regexp_extract(F.trim("uri"), "^model://([^/]+)", 1))
    index = models.where("place = 0").select(F.regexp_extract("file", "([^/]+)/[^/]+$", 1).alias("key"), "links", "static", F.size(F.split("file", "/")).alias("depth"), "file")
    index = index.groupBy("key").agg(F.min_by(F.struct("links", "static"), F.struct("depth", "file")).alias("m"))
    found = includes.join(index, "key").select(
        F.trim("name").alias("model"), F.coalesce(F.trim("pose"), F.lit(NO_POSE)).alias("model_pose"), F.col("m.static").alias("static"),
        F.lit("include").alias("source_type"), F.trim("uri").alias("source_uri"), F.col("m.links").alias("links"),
    )
    return found, includes.join(index, "key", "left_anti").drop("key")


def read_manifest(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    """A manifest's models. Unless `strict`, text that is no such document gives a row with _corrupt_record."""
    schema = MANIFEST if strict else T.StructType([*MANIFEST.fields, T.StructField("_corrupt_record", T.StringType())])
    return spark.read.schema(schema).option("multiLine", "true").option("mode", "FAILFAST" if strict else "PERMISSIVE").json(path)


def read_link_rows(spark: SparkSession, path: str) -> DataFrame:
    """The table of link measurements; empty text is null, other text than its column's type an error."""
    rows = spark.read.schema(LINK_ROWS).option("header", "true").option("nullValue", "").option("mode", "FAILFAST").option("enforceSchema", "false").csv(path)
    return not_empty(rows, "the link table")


def read_index(spark: SparkSession, path: str, schema: str, key: Sequence[str], expected: int | None = None) -> DataFrame:
    """An index table, whose key is unique and whose size, if given, is right."""
    rows = spark.read.schema(schema).option("header", "true").option("mode", "FAILFAST").csv(path)
    if not duplicates(rows, key).isEmpty():
        raise ValueError(f"{', '.join(key)} isn't unique")
    if expected is not None and (n := rows.count()) != expected:
        raise ValueError(f"{n} rows instead of {expected}")
    return rows


def file_listing(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """(path, length, depth) of a folder's files, contents unread."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder)
    return files.select("path", "length", F.size(F.split("path", "/")).alias("depth"))


def missing_paths(rows: DataFrame, column: str, listing: DataFrame) -> DataFrame:
    """Rows whose path isn't in the listing."""
    return rows.join(listing.select(F.col("path").alias(column)).distinct(), column, "left_anti")


def tool_output(lines: DataFrame) -> DataFrame:
    """paths_found, the first error and the result document of a solver's text output, by run."""
    text, w = F.col("value"), F.col("line_no")
    found = F.regexp_extract(text, r"paths_found\s*:\s*(\d+)", 1)
    return lines.groupBy("run").agg(
        F.max_by(F.when(found != "", found.cast("int")), F.when(found != "", w)).alias("paths_found"),
        F.min_by(F.when(text.startswith("ERROR:"), text), F.when(text.startswith("ERROR:"), w)).alias("first_error"),
        F.max_by(F.when(text.startswith("RESULT_JSON "), F.substr(text, F.lit(13))), F.when(text.startswith("RESULT_JSON "), w)).alias("result_json"),
    )
