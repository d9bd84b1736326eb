"""Vertices of PLY and OBJ meshes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.functions.strings import strict_double

VERTICES = "mesh_path string, vertex_idx long, x double, y double, z double"
# The scalar types of the PLY format.
PLY_TYPES = {
    "char": "i1", "int8": "i1", "uchar": "u1", "uint8": "u1", "short": "i2", "int16": "i2", "ushort": "u2", "uint16": "u2",
    "int": "i4", "int32": "i4", "uint": "u4", "uint32": "u4", "float": "f4", "float32": "f4", "double": "f8", "float64": "f8",
}
ORDERS = {"binary_little_endian": "<", "binary_big_endian": ">"}


def ply_vertices(data: bytes) -> np.ndarray:
    """The n by 3 coordinates of a PLY file; an error for other formats, list properties and short files."""
    end = data.find(b"end_header")
    if not data.startswith(b"ply") or end < 0:
        raise ValueError("no PLY header")
    body = data[data.index(b"\n", end) + 1 :]
    kind, elements = "", []
    for line in data[:end].decode("ascii", "replace").splitlines():
        word = line.split()
        if word[:1] == ["format"]:
            kind = word[1]
        elif word[:1] == ["element"]:
            elements.append((word[1], int(word[2]), []))
        elif word[:1] == ["property"]:
            elements[-1][2].append(word[1:])
    if not elements or elements[0][0] != "vertex":
        raise ValueError("vertices don't come first")
    _, n, properties = elements[0]
    if any(p[0] == "list" or p[0] not in PLY_TYPES for p in properties):
        raise ValueError("a vertex property isn't a number")
    names = [p[1] for p in properties]
    if not {"x", "y", "z"} <= set(names):
        raise ValueError("vertices have no x, y, z")
    if kind == "ascii":
        rows = [line.split() for line in body.decode("ascii").splitlines() if line.strip()][:n]
        if len(rows) < n or any(len(r) < len(names) for r in rows):
            raise ValueError("too few vertices")
        table = np.array([r[: len(names)] for r in rows], float).reshape(n, len(names))
        return table[:, [names.index(a) for a in "xyz"]]
    if kind not in ORDERS:
        raise ValueError(f"unknown PLY format {kind}")
    row = np.dtype([(name, ORDERS[kind] + PLY_TYPES[p[0]]) for name, p in zip(names, properties, strict=True)])
    if len(body) < n * row.itemsize:
        raise ValueError("too few vertices")
    table = np.frombuffer(body, row, n)
    return np.stack([table[a].astype(float) for a in "xyz"], axis=1)


def read_ply(spark: SparkSession, path: str) -> DataFrame:
    """A row per vertex; files are decoded whole, each by the task that reads it."""

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for mesh, content in zip(batch["path"], batch["content"], strict=True):
                xyz = ply_vertices(bytes(content))
                if not len(xyz):
                    raise ValueError(f"no vertices in {mesh}")
                yield pd.DataFrame({"mesh_path": mesh, "vertex_idx": np.arange(len(xyz)), "x": xyz[:, 0], "y": xyz[:, 1], "z": xyz[:, 2]})

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.ply").option("recursiveFileLookup", "true").load(path)
    return files.select("path", "content").mapInPandas(decode, VERTICES)


def read_obj(spark: SparkSession, path: str) -> DataFrame:
    """A row per vertex line of three numbers or more, numbered from 0; shorter lines are left out, a vertex that isn't
    a number is an error, and so is a file without vertices."""
    files = spark.read.option("pathGlobFilter", "*.obj").option("recursiveFileLookup", "true").text(path, wholetext=True)
    words = F.transform(F.filter(F.split("value", r"\r?\n"), lambda line: line.startswith("v ")), lambda line: F.split(F.trim(line), r"\s+"))
    points = F.filter(words, lambda w: F.size(w) > 3)
    rows = files.select(F.col("_metadata.file_path").alias("mesh_path"), points.alias("points"))
    some = F.when(F.size("points") > 0, F.col("points")).otherwise(F.raise_error(F.concat(F.lit("no vertices in "), F.col("mesh_path"))).cast("array<array<string>>"))
    rows = rows.select("mesh_path", F.posexplode(some).alias("vertex_idx", "w"))
    return rows.select("mesh_path", F.col("vertex_idx").cast("long").alias("vertex_idx"), *[strict_double(F.get("w", F.lit(k)), a).alias(a) for k, a in enumerate("xyz", 1)])


def read_meshes(spark: SparkSession, path: str) -> DataFrame:
    return read_ply(spark, path).unionByName(read_obj(spark, path))


def entry_vertices(entries: DataFrame, vertices: DataFrame) -> DataFrame:
    """Each entry (mesh_path and others) with all vertices of its mesh, which was read once for however many entries.
    A path of another kind than PLY and OBJ, and one that has no vertices, is an error."""
    kind = F.lower(F.regexp_extract("mesh_path", r"\.([^./]+)$", 1))
    wrong = F.when(~kind.isin("ply", "obj"), F.lit("unsupported mesh ")).when(F.col("vertex_idx").isNull(), F.lit("no vertices in "))
    path = F.when(wrong.isNull(), F.col("mesh_path")).otherwise(F.raise_error(F.concat(wrong, "mesh_path")).cast("string"))
    return entries.join(vertices, "mesh_path", "left").withColumn("mesh_path", path)
