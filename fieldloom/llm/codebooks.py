"""Compression of vectors by codes: each part of a vector is replaced by the nearest entry of its position's codebook,
which weighted Lloyd rounds fit to the distinct parts. All arithmetic is on integers."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldloom.llm.staging import staged

PARTS, ENTRIES, ROUNDS, UNIT = 8, 16, 6, 4096
#: Parts whose distances to all entries are taken at once.
AT_ONCE = 1 << 13
#: A part that as many vectors have as one in HOT_SHARE, and HOT_LEAST at least, is joined by broadcast; there are HOT_SHARE
#: of them at most for each position.
HOT_SHARE, HOT_LEAST = 20_000, 64
#: Labels whose sums go to all tasks; more are joined by shuffling.
MOST_BROADCAST = 100_000
CUT = "row long, vec_id long, label string, part int, value binary"


def _limit(width: int) -> int:
    """Integers beyond it are taken as it, so that the error of a vector of `width` components fits 64 bits."""
    return min((1 << 31) - 1, isqrt((1 << 62) // max(width, 1)) // 2)


def integer_rows(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Which rows of a list column are kept, and their components as integers, floor(UNIT * x). Dropped: null rows,
    null or non-finite components, and lengths other than `width`."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    size = np.diff(column.offsets.to_numpy())
    keep = column.is_valid().to_numpy(zero_copy_only=False) & (size == width)
    flat = column.values.cast(pa.float64()).to_numpy(zero_copy_only=False)  # null: nan
    at = column.offsets.to_numpy()[:-1][keep]
    x = flat[at[:, None] + np.arange(width)]
    good = np.isfinite(x).all(axis=1)
    keep[keep] = good
    limit = _limit(width)
    with np.errstate(over="ignore"):
        return keep, np.clip(np.floor(x[good] * UNIT), -limit, limit).astype(np.int64)


def cut_vectors(vectors: DataFrame, width: int) -> DataFrame:
    """(row, vec_id, label, part, value): the PARTS parts of each kept vector; value: its integers, 4 bytes each."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row, step = TaskContext.get().partitionId() << 40, width // PARTS
        for batch in batches:
            for a in range(0, batch.num_rows, AT_ONCE):
                some = batch.slice(a, AT_ONCE)
                keep, x = integer_rows(some.column(2), width)
                n, at = len(x), pa.array(np.repeat(np.flatnonzero(keep), PARTS))
                ends = np.arange(0, n * PARTS + 1, dtype=np.int32) * (4 * step)
                value = pa.Array.from_buffers(pa.binary(), n * PARTS, [None, pa.py_buffer(ends), pa.py_buffer(x.astype("<i4").tobytes())])
                columns = [pa.array(np.repeat(np.arange(row, row + n), PARTS)), some.column(0).take(at), some.column(1).take(at), pa.array(np.tile(np.arange(PARTS, dtype=np.int32), n)), value]
                yield pa.RecordBatch.from_arrays(columns, names=["row", "vec_id", "label", "part", "value"])
                row += n

    return vectors.select(F.col("vec_id").cast("long"), F.col("label").cast("string"), "embedding").mapInArrow(cut, CUT)


def _integers(value: pa.Array) -> np.ndarray:
    return np.array([np.frombuffer(x, "<i4") for x in value.to_pylist()], np.int64)


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest entry of each row by squared distance, of equally near ones the first, and that distance."""
    code, error = np.empty(len(x), np.int64), np.empty(len(x), np.int64)
    for a in range(0, len(x), AT_ONCE):
        d = ((x[a : a + AT_ONCE, None, :] - book) ** 2).sum(axis=2)
        code[a : a + AT_ONCE] = d.argmin(axis=1)
        error[a : a + AT_ONCE] = d.min(axis=1)
    return code, error


def _by_part(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Of rows (part, value, ...): each part position in them, its rows and their integers."""
    part = batch.column(0).to_numpy()
    for p in np.unique(part).tolist():
        at = np.flatnonzero(part == p)
        yield p, at, _integers(batch.column(1).take(pa.array(at)))


def lloyd_round(distinct: DataFrame, books: np.ndarray) -> np.ndarray:
    """The codebooks (part, entry, place) after a round over the distinct parts (part, value, weight): each entry
    becomes the floor of the weighted mean of the parts nearest to it; one that is nearest to none stays. The driver
    gets a row for each entry and place."""
    sent = distinct.sparkSession.sparkContext.broadcast(books)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            weight = batch.column(2).to_numpy()
            rows: list[tuple[int, int, int, int]] = []
            for p, at, x in _by_part(batch):
                code, _ = nearest(x, sent.value[p])
                order = np.argsort(code, kind="stable")
                start = np.flatnonzero(np.concatenate([[True], np.diff(code[order]) > 0]))
                w = weight[at][order]
                sums = np.add.reduceat(np.hstack([w[:, None], x[order] * w[:, None]]), start, axis=0)
                rows += [(p, int(e), k - 1, int(s)) for e, own in zip(code[order][start], sums, strict=True) for k, s in enumerate(own)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int32(), pa.int32(), pa.int64()), strict=True)], names=["part", "entry", "place", "total"])

    sums = distinct.select("part", "value", "weight").mapInArrow(add, "part int, entry int, place int, total long")
    found = {(r.part, r.entry, r.place): int(r.total) for r in sums.groupBy("part", "entry", "place").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect()}
    out = books.copy()
    for (p, e, k), total in found.items():
        if k >= 0:
            out[p, e, k] = total // found[p, e, -1]
    return out


def _start(vectors: DataFrame, entries: int) -> np.ndarray:
    """Codebooks (part, entry, place): the parts of the kept vectors with the smallest vec_ids. A vec_id that
    several rows have counts once, with its least vector; the vectors' length is that of the smallest vec_id."""
    good = F.col("embedding").isNotNull() & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.where(good & F.col("vec_id").isNotNull()).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    first = rows.orderBy("vec_id", "embedding").first()
    width = len(first.embedding) if first else 0
    if not width or width % PARTS:
        return np.zeros((PARTS, 0, 0), np.int64)
    same = rows.where(F.size("embedding") == width).groupBy("vec_id").agg(F.min("embedding").alias("embedding")).orderBy("vec_id").limit(entries).collect()
    _, x = integer_rows(pa.array([r.embedding for r in same], pa.list_(pa.float64())), width)
    return np.ascontiguousarray(x.reshape(len(x), PARTS, -1).transpose(1, 0, 2))


def fitted(vectors: DataFrame, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, DataFrame, np.ndarray]:
    """The cut vectors, their distinct parts (part, value, weight), and the codebooks."""
    books = _start(vectors, entries)
    cut = staged(cut_vectors(vectors, books.shape[2] * PARTS) if books.size else vectors.sparkSession.createDataFrame([], CUT), "cut-vectors")
    distinct = staged(cut.groupBy("part", "value").agg(F.count(F.lit(1)).alias("weight")), "distinct-parts")
    for _ in range(rounds if books.size else 0):
        books = lloyd_round(distinct, books)
    return cut, distinct, books


def coded(distinct: DataFrame, books: np.ndarray) -> DataFrame:
    """(part, value, weight, code, error) of each distinct part."""
    sent = distinct.sparkSession.sparkContext.broadcast(books)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            code, error = np.zeros((2, batch.num_rows), np.int64)
            for p, at, x in _by_part(batch):
                code[at], error[at] = nearest(x, sent.value[p])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(code.astype(np.int32)), pa.array(error)], names=["part", "value", "weight", "code", "error"])

    return distinct.select("part", "value", "weight").mapInArrow(assign, "part int, value binary, weight long, code int, error long")


def joined_codes(cut: DataFrame, codes: DataFrame) -> DataFrame:
    """(row, vec_id, label, code, error): codes and errors of distinct parts joined back to the vectors. Parts that many
    vectors have go to all tasks, so no task gets all of their rows."""
    most = codes.groupBy("part").agg(F.sum("weight").alias("n")).agg(F.coalesce(F.max("n"), F.lit(0))).first()[0]
    hot = F.col("weight") >= max(HOT_LEAST, -(-most // HOT_SHARE))
    codes, keys = staged(codes, "part-codes"), ["part", "value"]
    many = F.broadcast(codes.where(hot).select(*keys, F.struct("code", "error").alias("hot")))
    rest = codes.where(~hot).select(*keys, "code", "error")
    both = cut.join(many, keys, "left")
    own = both.where("hot IS NOT NULL").select("row", "vec_id", "label", "part", "hot.code", "hot.error")
    own = own.unionByName(both.where("hot IS NULL").drop("hot").join(rest, keys).select("row", "vec_id", "label", "part", "code", "error"))
    hexed: Column = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "code"))), lambda x: F.lower(F.lpad(F.hex(x["code"]), 2, "0"))), "")
    return own.groupBy("row").agg(F.first("vec_id").alias("vec_id"), F.first("label").alias("label"), hexed.alias("code"), F.sum("error").alias("error"))


def compressed(vectors: DataFrame) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) of every kept vector.

    Vectors that are null, or hold null or non-finite components, go, as do those of another length than the
    smallest vec_id's has; that must be a multiple of PARTS, or all go. Integers are clipped where a vector's error
    would pass 64 bits (`_limit`; 2^27 for 64 components). Codebooks start with the ENTRIES smallest vec_ids, with fewer vectors
    as many; repeated rows each give a row, a null vec_id gives one but no entry, null labels are one label. Other
    columns are not looked at; no kept vectors give no rows.
    """
    cut, distinct, books = fitted(vectors)
    text = ",".join(map(str, books.ravel().tolist()))
    rows = staged(joined_codes(cut, coded(distinct, books)), "coded-vectors")
    sums = staged(rows.groupBy(F.col("label").alias("own")).agg(F.sum("error").alias("label_error")), "label-errors")
    few = sums.count() <= MOST_BROADCAST
    out = rows.join(F.broadcast(sums) if few else sums, F.col("label").eqNullSafe(F.col("own")))
    return out.select("vec_id", "code", "error", "label_error", F.lit(hashlib.sha256(text.encode()).hexdigest()).alias("codebooks_sha256"))


def _sql() -> str:
    near = """
        near{k} AS MATERIALIZED (
            SELECT vec_id, part, entry, error FROM (
                SELECT v.vec_id, v.part, b.entry, sum((v.x - b.x) * (v.x - b.x)) AS error FROM parts v JOIN book{k} b USING (part, place) GROUP BY ALL
            ) QUALIFY row_number() OVER (PARTITION BY vec_id, part ORDER BY error, entry) = 1
        )"""
    # // cuts towards zero, so the remainder is made one that isn't negative first
    book = """
        book{next} AS MATERIALIZED (
            SELECT part, entry, place, coalesce((total - ((total % n) + n) % n) // n, old.x)::BIGINT AS x FROM book{k} old LEFT JOIN (
                SELECT part, entry, place, sum(x)::HUGEINT AS total, count(*)::HUGEINT AS n FROM near{k} JOIN parts USING (vec_id, part) GROUP BY ALL
            ) USING (part, entry, place)
        )"""
    rounds = ",".join(near.format(k=k) + "," + book.format(k=k, next=k + 1) for k in range(ROUNDS))
    return f"""
        WITH kept AS (
            SELECT vec_id, label, embedding FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ),
        parts AS MATERIALIZED (
            SELECT vec_id, (i - 1) // (size // {PARTS}) AS part, (i - 1) % (size // {PARTS}) AS place, floor({UNIT} * x::DOUBLE)::BIGINT AS x
            FROM (SELECT vec_id, len(embedding) AS size, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM kept)
        ),
        first AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM kept QUALIFY entry < {ENTRIES}),
        book0 AS MATERIALIZED (SELECT part, entry, place, x FROM parts JOIN first USING (vec_id)),
        {rounds},
        {near.format(k=ROUNDS)},
        codes AS (SELECT vec_id, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, sum(error)::BIGINT AS error FROM near{ROUNDS} GROUP BY vec_id),
        hash AS (SELECT sha256(string_agg(x::VARCHAR, ',' ORDER BY part, entry, place)) AS codebooks_sha256 FROM book{ROUNDS})
        SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256
        FROM codes JOIN kept USING (vec_id) CROSS JOIN hash"""


RESULT_SQL = _sql()
