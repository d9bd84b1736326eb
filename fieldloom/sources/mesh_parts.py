"""PLY meshes by byte ranges: a data source that plans rows of fixed width from the header and reads chosen columns."""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from fieldloom.sources.files import opened, read_range, size_of
from fieldloom.sources.meshes import ORDERS, PLY_TYPES

#: Bytes of vertices that a task reads, and of a header that are looked for its end at a time.
PART_BYTES, HEADER_BYTES = 32 << 20, 1 << 14
SPARK_TYPES = {"i1": "int", "u1": "int", "i2": "int", "u2": "int", "i4": "int", "u4": "long", "f4": "double", "f8": "double"}
ARROW_TYPES = {"int": pa.int32(), "long": pa.int64(), "double": pa.float64()}


@dataclass
class Header:
    """Where the body begins, how many vertices there are, and (name, kind) of their properties; order: of bytes, empty
    for text."""

    body: int
    vertices: int
    order: str
    properties: list[tuple[str, str]]

    @property
    def row(self) -> np.dtype:
        return np.dtype([(n, (self.order or "<") + k) for n, k in self.properties])

    @classmethod
    def of(cls, path: str) -> Header:
        data, size = b"", size_of(path)
        while b"end_header" not in data or b"\n" not in data[data.find(b"end_header") :]:
            more = read_range(path, len(data), min(size, len(data) + HEADER_BYTES))
            if not more or not (data + more).startswith(b"ply"):
                raise ValueError(f"no PLY header in {path}")
            data += more
        end = data.index(b"end_header")
        order, elements = None, []
        for line in data[:end].decode("ascii", "replace").splitlines():
            word = line.split()
            if word[:1] == ["format"]:
                order = {**ORDERS, "ascii": ""}.get(word[1])
                if order is None:
                    raise ValueError(f"unknown PLY format {word[1]} in {path}")
            elif word[:1] == ["element"]:
                elements.append((word[1], int(word[2]), []))
            elif word[:1] == ["property"]:
                elements[-1][2].append(word[1:])
        if order is None or not elements or elements[0][0] != "vertex":
            raise ValueError(f"vertices don't come first in {path}")
        _, n, found = elements[0]
        if any(p[0] == "list" or p[0] not in PLY_TYPES for p in found):
            raise ValueError(f"a vertex property isn't a number in {path}")
        if not n:
            raise ValueError(f"no vertices in {path}")
        out = cls(data.index(b"\n", end) + 1, n, order, [(p[1], PLY_TYPES[p[0]]) for p in found])
        if order and size < out.body + n * out.row.itemsize:
            raise ValueError(f"too few vertices in {path}")
        return out


@dataclass
class Rows(InputPartition):
    path: str
    header: Header
    first: int
    end: int


class MeshReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict[str, str]):
        self.schema, self.paths, self.most = schema, json.loads(options["paths"]), int(options["part_bytes"])

    def partitions(self) -> Sequence[InputPartition]:
        out = []
        for path in self.paths:
            h = Header.of(path)
            missing = set(self.schema.names) - {"mesh_path", "vertex_idx"} - {n for n, _ in h.properties}
            if missing:
                raise ValueError(f"vertices have no {', '.join(sorted(missing))} in {path}")
            # lines of text aren't of one width, so their rows can't be told before they are read
            parts = max(1, -(-h.vertices * h.row.itemsize // self.most)) if h.order else 1
            out += [Rows(path, h, h.vertices * k // parts, h.vertices * (k + 1) // parts) for k in range(parts)]
        return out

    def read(self, partition: Rows) -> Iterator[pa.RecordBatch]:
        h, names = partition.header, [n for n, _ in partition.header.properties]
        if h.order:
            wide = h.row.itemsize
            body = read_range(partition.path, h.body + partition.first * wide, h.body + partition.end * wide)
            table = np.frombuffer(body, h.row)
        else:
            text = read_range(partition.path, h.body, size_of(partition.path)).decode("ascii")
            rows = [line.split() for line in text.splitlines() if line.strip()][: h.vertices]
            if len(rows) < h.vertices or any(len(r) < len(names) for r in rows):
                raise ValueError(f"too few vertices in {partition.path}")
            values = np.array([r[: len(names)] for r in rows], float).reshape(-1, len(names))
            table = {n: values[:, k] for k, n in enumerate(names)}
        n = partition.end - partition.first
        for a in range(0, n, 1 << 16):
            b = min(n, a + (1 << 16))
            made = {"mesh_path": pa.array([partition.path] * (b - a), pa.string()), "vertex_idx": pa.array(np.arange(partition.first + a, partition.first + b))}
            columns = []
            for f in self.schema:
                kind = ARROW_TYPES.get({"integer": "int", "bigint": "long"}.get(f.dataType.typeName(), f.dataType.typeName()))
                columns.append(made[f.name] if f.name in made else pa.array(table[f.name][a:b].astype(kind.to_pandas_dtype())))
            yield pa.RecordBatch.from_arrays(columns, names=self.schema.names)


class MeshSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "ply_vertices"

    def schema(self) -> str:
        return "mesh_path string, vertex_idx long, x double, y double, z double"

    def reader(self, schema: StructType) -> DataSourceReader:
        return MeshReader(schema, self.options)


def read_ply_parts(spark: SparkSession, paths: Sequence[str], columns: Sequence[str] = ("x", "y", "z"), part_bytes: int = PART_BYTES) -> DataFrame:
    """(mesh_path, vertex_idx, columns): a row per vertex of each of the files, with the chosen properties, in the order of
    files and vertices; a path that comes twice is read once. A binary file is read by many tasks, `part_bytes` each; a text file by one.
    Numbers come as int, long or double. A file without such a property, without vertices, too short, or of another form is an
    error; no paths give no rows."""
    paths = list(dict.fromkeys(paths))
    kinds: dict[str, str] = {}
    if paths:
        kinds = {n: SPARK_TYPES[k] for n, k in Header.of(paths[0]).properties}
    schema = ", ".join(["mesh_path string", "vertex_idx long", *[f"`{c}` {kinds.get(c, 'double')}" for c in columns]])
    if not paths:
        return spark.createDataFrame([], schema)
    spark.dataSource.register(MeshSource)
    return spark.read.format("ply_vertices").schema(schema).option("paths", json.dumps(paths)).option("part_bytes", part_bytes).load()


def write_ply_parts(vertices: DataFrame, folder: str) -> DataFrame:
    """(mesh_path, vertices): writes the rows of each task as a binary PLY file in `folder`, which all executors share,
    and tells of each. Columns are long (as int), int or double; a task that is run again writes its file again."""
    kinds = {"int": "int", "bigint": "int", "double": "double", "float": "float"}
    names = [(n, kinds[t]) for n, t in vertices.dtypes]

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = np.dtype([(n, "<" + PLY_TYPES[k]) for n, k in names])
        parts = []
        for batch in batches:
            table = np.empty(batch.num_rows, row)
            for k, (n, _) in enumerate(names):
                table[n] = batch.column(k).to_numpy(zero_copy_only=False)
            parts.append(table.tobytes())
        n = sum(map(len, parts)) // row.itemsize
        if n:
            path = f"{folder}/part-{TaskContext.get().partitionId():06d}.ply"
            head = ["ply", "format binary_little_endian 1.0", f"element vertex {n}", *[f"property {k} {name}" for name, k in names], "end_header", ""]
            store, inside = opened(path)
            store.create_dir(inside.rsplit("/", 1)[0], recursive=True)
            with store.open_output_stream(inside) as file:
                file.write("\n".join(head).encode() + b"".join(parts))
            yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([n])], names=["mesh_path", "vertices"])

    return vertices.mapInArrow(write, "mesh_path string, vertices long")
