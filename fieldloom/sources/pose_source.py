"""Motion logs as a batch and stream source: blocks with nested braces, found by a stack from any place in a file."""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache
from itertools import islice
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

from fieldloom.sources.files import files_below, ranges, read_range, size_of

SCHEMA = "file string, start long, model string, link string, sec long, nsec int, header map<string,string>, at array<double>, orientation array<double>, error string"
#: Bytes of a log's part, and that are looked at together.
PART_BYTES, STEP = 32 << 20, 1 << 16
#: From so many tasks on, one reads several small parts, as long as they have no more bytes than a part by default: what a task
#: and its output file cost would else be most of the time.
TASKS = 256
OPEN = b"pose {"
_QUOTED = r'"(?:[^"\\\n]++|\\.)*+"'
_FIELD = re.compile(r'([A-Za-z_]\w*+)\s*+(?:\{|:\s*+("(?:[^"\\]++|\\.)*+"|[^\s{}"]++))|(\})')
_STACK = re.compile(rf"{_QUOTED}|[{{}}]".encode())
ARROW = pa.schema(
    [("file", pa.string()), ("start", pa.int64()), ("model", pa.string()), ("link", pa.string()), ("sec", pa.int64()), ("nsec", pa.int32()), ("header", pa.map_(pa.string(), pa.string()))]
    + [("at", pa.list_(pa.float64())), ("orientation", pa.list_(pa.float64())), ("error", pa.string())]
)
#: Rows that are handed to Spark together.
ROWS = 4096


def _nested(depth: int) -> str:
    return rf'(?:[^{{}}"]++|{_QUOTED}|\{{{_nested(depth - 1)}\}})*+' if depth else rf'(?:[^{{}}"]++|{_QUOTED})*+'


#: A block whose braces match, nested so deep and with all quotes closed, as nearly all are; others are looked at brace by brace.
_WHOLE = re.compile(rf"pose \{{{_nested(8)}\}}".encode())


def _inner(tree: dict[str, list[Any]], name: str) -> dict[str, list[Any]]:
    found = [x for x in tree.get(name, []) if isinstance(x, dict)]
    return found[-1] if found else {}


@lru_cache(256)
def _places(names: tuple[str, ...], given: tuple[bool, ...], closes: tuple[str, ...]) -> tuple[Any, list[tuple[Any, Any]], list[Any]]:
    """Which of a block's fields are its name, its header's keys and values and its numbers: found once for all blocks with
    the same fields. A field that comes again has its last value; one that is nested where a value should be is a dict."""
    root: dict[str, list[Any]] = {}
    stack = [root]
    for i, (name, value, close) in enumerate(zip(names, given, closes, strict=True)):
        if close:
            if len(stack) > 1:
                stack.pop()
        elif value:
            stack[-1].setdefault(name, []).append(i)
        else:
            inner: dict[str, list[Any]] = {}
            stack[-1].setdefault(name, []).append(inner)
            stack.append(inner)
    last = lambda tree, name: tree[name][-1] if name in tree else None
    pose = _inner(root, "pose") or root
    header = _inner(pose, "header")
    stamp = _inner(header, "stamp") or _inner(pose, "stamp")
    pairs = [(last(x, "key"), last(x, "value")) for x in header.get("data", []) if isinstance(x, dict) and "key" in x]
    at, turn = _inner(pose, "position"), _inner(pose, "orientation")
    return last(pose, "name"), pairs, [*[last(stamp, n) for n in ("sec", "nsec")], *[last(at, a) for a in "xyz"], *[last(turn, a) for a in "xyzw"]]


def _text(values: Sequence[str], place: Any) -> str:
    if place is None:
        return ""
    if isinstance(place, dict):
        told = lambda x: {k: [told(v) for v in vs] for k, vs in x.items()} if isinstance(x, dict) else _text(values, x)
        return str(told(place))
    value = values[place]
    return value[1:-1] if value[0] == '"' else value


def _number(values: Sequence[str], place: Any) -> float | None:
    """Numbers that are left out are 0; what isn't one is null."""
    if place is None:
        return 0.0
    try:
        return float(_text(values, place))
    except ValueError:
        return None


def parsed(text: str, whole: bool = True) -> tuple:
    """model, link, sec, nsec, header, at, orientation and error (the first thing that is wrong) of a block."""
    names, values, closes = zip(*found, strict=True) if (found := _FIELD.findall(text)) else ((), (), ())
    named, told, places = _places(names, tuple(map(bool, values)), closes)
    pairs = {_text(values, k): _text(values, v) for k, v in told}
    name = "" if isinstance(named, dict) else _text(values, named)
    scope, _, own = name.rpartition("::")
    sec, nsec, *numbers = [_number(values, p) for p in places]
    at, turn = numbers[:3], numbers[3:]
    finite = all(v is not None and math.isfinite(v) for v in numbers)
    problems = [
        (not whole, "braces don't match"),
        (not (scope and own), "name isn't model::link"),
        ("child_frame_id" in pairs and pairs["child_frame_id"] != name, "header and name differ"),
        (not finite, "a number isn't finite"),
        (finite and not any(turn), "orientation has no length"),
    ]
    error = next((why for bad, why in problems if bad), None)
    long = lambda v: int(v) if v is not None and math.isfinite(v) else None
    return scope or None, own or None, long(sec), long(nsec), pairs, at, turn, error


def _begins(data: bytes, at: int) -> bool:
    return data.startswith(OPEN, at) and (at == 0 or data[at - 1 : at] == b"\n")


def _found_before(path: str, place: int) -> int:
    """Where the last block begins whose opening is whole up to `place`; 0 if there is none."""
    end = place
    while end > 0:
        start = max(0, end - STEP)
        low = max(0, start - 1)
        data = b"\n" * (low == 0) + read_range(path, low, min(end + len(OPEN), place))
        at = data.rfind(b"\n" + OPEN)
        if at >= 0:
            return low + at + (low > 0)
        end = start
    return 0


def blocks_between(path: str, start: int, end: int, last: bool) -> Iterator[tuple[int, bytes, bool]]:
    """(start, text, whole) of the blocks that end after `start` and up to `end`; `last`: one that the file's end cuts off
    comes too, as not whole. A block begins with `pose {` at the start of a line, as nested ones don't, and ends with the
    brace that closes it, however many are within; so each block is in one range only, also if it began in another. One in
    which braces don't match ends with the next one's opening."""
    place = _found_before(path, start)
    data, opened, depth, looked = b"", -1, 0, 0  # data begins at `place`
    read = place
    while True:
        more = read_range(path, read, min(read + STEP, end))
        data, read = data + more, read + len(more)
        done = read >= end or not more
        # not beyond a line's end, so no text in quotes is cut
        limit = len(data) if done else data.rfind(b"\n") + 1
        following = None
        while looked < limit:
            if opened < 0:
                at = data.find(OPEN, looked, limit)
                while at >= 0 and not (_begins(data, at) and (at or place == 0 or read_range(path, place - 1, place) == b"\n")):
                    at = data.find(OPEN, at + 1, limit)
                if at < 0:
                    looked = max(looked, limit - len(OPEN) + 1) if not done else limit
                    break
                opened, depth, looked, following = at, 0, at, data.find(b"\n" + OPEN, at + 1, limit)
                found = _WHOLE.match(data, at, limit)
                if found and (following < 0 or found.end() <= following):
                    looked = found.end()
                    if place + looked > start:
                        yield place + opened, found.group(), True
                    opened = -1
                    continue
            found = _STACK.search(data, looked, limit)
            if following is None:
                following = data.find(b"\n" + OPEN, opened + 1, limit)
            if following >= 0 and (not found or following < found.start()):
                if place + following + 1 + len(OPEN) > start:
                    yield place + opened, data[opened : following + 1], False
                looked, opened = following + 1, -1
                continue
            if not found:
                looked = limit
                break
            looked = found.end()
            depth += {b"{": 1, b"}": -1}.get(found.group(), 0)
            if depth == 0 and found.group() == b"}":
                if place + looked > start:
                    yield place + opened, data[opened:looked], True
                opened = -1
        if done:
            if last and opened >= 0:
                yield place + opened, data[opened:], False
            return
        # what was read and isn't of an open block is left behind; a line's end before it stays
        keep = opened if opened >= 0 else max(0, looked - 1)
        data, place, looked, opened = data[keep:], place + keep, looked - keep, opened - keep if opened >= 0 else -1


@dataclass
class Range(InputPartition):
    path: str
    start: int
    end: int
    last: bool


@dataclass
class Ranges(InputPartition):
    parts: list[Range]


def dealt(parts: Sequence[Range], most: int) -> list[Ranges]:
    """The parts of at most so many bytes, by tasks."""
    n = max(1, min(PART_BYTES // most, -(-len(parts) // TASKS)))
    return [Ranges(list(parts[k : k + n])) for k in range(0, len(parts), n)]


def _rows(task: Ranges) -> Iterator[pa.RecordBatch]:
    blocks = ((part.path, *block) for part in task.parts for block in blocks_between(part.path, part.start, part.end, part.last))
    while some := list(islice(blocks, ROWS)):
        rows = [(path, start, *parsed(text.decode("utf-8", "replace"), whole)) for path, start, text, whole in some]
        columns = [[list(x.items()) for x in c] if pa.types.is_map(f.type) else c for f, c in zip(ARROW, zip(*rows, strict=True), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for f, c in zip(ARROW, columns, strict=True)], schema=ARROW)


class PoseReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.paths, self.most = json.loads(options["paths"]), int(options["part_bytes"])

    def partitions(self) -> Sequence[InputPartition]:
        sizes = {p: size_of(p) for p in self.paths}
        return dealt([Range(path, a, b, b == sizes[path]) for path, a, b in ranges([(p, sizes[p]) for p in self.paths], self.most)], self.most)

    def read(self, partition: Ranges) -> Iterator[pa.RecordBatch]:
        return _rows(partition)


class PoseStream(DataSourceStreamReader):
    """Files below a folder that grow or arrive; an offset says up to which byte each file was read. A block is in the
    batch in which its closing brace came."""

    def __init__(self, options: dict[str, str]):
        self.folder, self.most = options["path"], int(options["part_bytes"])

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        return {p: size_of(p) for p in files_below(self.folder)}

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        out = []
        for path, size in sorted(end.items()):
            begin = start.get(path, 0)
            out += [Range(path, begin + a, begin + b, False) for _, a, b in ranges([(path, size - begin)], self.most) if size > begin]
        return dealt(out, self.most)

    def read(self, partition: Ranges) -> Iterator[pa.RecordBatch]:
        return _rows(partition)


class PoseSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "pose_blocks"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return PoseReader(self.options)

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return PoseStream(self.options)


def read_pose_blocks(spark: SparkSession, paths: Sequence[str], part_bytes: int = PART_BYTES) -> DataFrame:
    """A row for each block of the files, with its place in its file, and what is wrong with it (null: nothing). A file is read
    by many tasks; no paths give no rows."""
    if not paths:
        return spark.createDataFrame([], SCHEMA)
    spark.dataSource.register(PoseSource)
    return spark.read.format("pose_blocks").option("paths", json.dumps(list(paths))).option("part_bytes", part_bytes).load()


def stream_pose_blocks(spark: SparkSession, folder: str, part_bytes: int = PART_BYTES) -> DataFrame:
    """The same rows of a folder's files as they grow, as a stream that goes on from its checkpoint's offsets. A block that
    isn't whole yet waits for its end."""
    spark.dataSource.register(PoseSource)
    return spark.readStream.format("pose_blocks").option("part_bytes", part_bytes).load(folder)
