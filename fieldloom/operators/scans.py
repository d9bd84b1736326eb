"""Ordinals and lags of keys of any size: a prefix scan in two passes over sorted parts."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldloom.operators.rounds import settled

PART, PLACE, HEAD, TAIL, TIE = "__part", "__place", "__head", "__tail", "__tie"


def _after(last: pa.Array | None, column: pa.Array) -> pa.Array:
    """`column` with the value before it, which is null at first."""
    return pa.concat_arrays([pa.nulls(1, column.type) if last is None else last, column])


def _changes(column: pa.Array) -> np.ndarray:
    """Whether each value differs from the one before it; nulls are equal to each other."""
    a, b = column.slice(0, len(column) - 1), column.slice(1)
    differs = pc.fill_null(pc.not_equal(a, b), False)
    return pc.or_(differs, pc.xor(a.is_null(), b.is_null())).to_numpy(zero_copy_only=False)


def _first_pass(keys: Sequence[str], lags: Mapping[str, str]):
    """Of the rows of a sorted part: its number, each row's place among the part's rows of its key, the values
    before it, and whether it is of the part's first key or the part's last row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        last: dict[str, pa.Array] | None = None
        count, in_head, held = 0, True, None
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            columns = {c: _after(last and last[c], batch.column(c)) for c in {*keys, *lags.values()}}
            new = np.zeros(n, bool)
            for c in keys:
                new |= _changes(columns[c])
            new[0] |= last is None
            at = np.arange(n)
            start = np.maximum.accumulate(np.where(new, at, -1))
            place = np.where(start >= 0, at - start, at + count)
            runs = np.cumsum(new)
            head = in_head & (runs == (last is None))
            before = pa.array(at, mask=new)
            out = [*batch.columns, pa.array(np.full(n, part, np.int64)), pa.array(place.astype(np.int64)), *[columns[c].take(before) for c in lags.values()], pa.array(head)]
            if held is not None:
                yield pa.RecordBatch.from_arrays([*held, pa.array([False])], names=names)
            names = [*batch.schema.names, PART, PLACE, *lags, HEAD, TAIL]
            held = [c.slice(n - 1) for c in out]
            yield pa.RecordBatch.from_arrays([*[c.slice(0, n - 1) for c in out], pa.array(np.zeros(n - 1, bool))], names=names)
            last, count, in_head = {c: x.slice(n) for c, x in columns.items()}, int(place[-1]) + 1, bool(head[-1])
        if held is not None:
            yield pa.RecordBatch.from_arrays([*held, pa.array([True])], names=names)

    return run


def numbered(df: DataFrame, keys: Sequence[str], order: Sequence[str], ordinal: str, lags: Mapping[str, str] | None = None) -> DataFrame:
    """`df` with `ordinal`, each row's place from 0 among the rows of its key by `order`, and with the columns `lags`
    (new name: column), the values of the row before it, null for a key's first row.

    Rows are dealt out by ranges of (keys, order), so a key with many rows is many parts, and sorted once. The first
    pass numbers a part's rows and keeps its last row; the second adds what earlier parts of the same key hold, a row for
    each part. Nulls are a key like others and come first in the order; rows that are equal in it follow each other by a hash of all
    columns. No rows give none.
    """
    lags = dict(lags or {})
    plain = [F.col(f"`{c}`") for c, t in df.dtypes if not t.startswith(("map", "variant"))]
    # Spark hands columns to a function by unquoted names, so they go by their places
    names = {c: f"__c{i}" for i, c in enumerate(df.columns)}
    by = [*[F.col(f"`{c}`") if c in names else F.col(c) for c in (*keys, *order)], F.col(TIE)]
    rows = df.withColumn(TIE, F.xxhash64(*plain)).repartitionByRange(*by).sortWithinPartitions(*by).drop(TIE).toDF(*names.values())
    kinds = {f.name: f.dataType for f in df.schema}
    more = [T.StructField(PART, T.LongType()), T.StructField(PLACE, T.LongType()), *[T.StructField(n, kinds[c]) for n, c in lags.items()]]
    schema = T.StructType([*[T.StructField(names[f.name], f.dataType) for f in df.schema], *more, T.StructField(HEAD, T.BooleanType()), T.StructField(TAIL, T.BooleanType())])
    rows = settled(rows.mapInArrow(_first_pass([names[k] for k in keys], {n: names[c] for n, c in lags.items()}), schema), "numbered")

    named = [F.col(names[k]).alias(f"__key{i}") for i, k in enumerate(keys)]
    values = F.struct(F.lit(True).alias("__any"), *[F.col(names[c]).alias(n) for n, c in lags.items()])
    heads = rows.where(F.col(HEAD) & (F.col(PLACE) == 0)).select(PART, *named, F.lit(0).alias("__kind"), F.lit(None).cast("long").alias("__n"), F.when(F.lit(False), values).alias("__values"))
    tails = rows.where(TAIL).select(PART, *named, F.lit(1).alias("__kind"), (F.col(PLACE) + 1).alias("__n"), values.alias("__values"))
    earlier = Window.partitionBy(*[f"__key{i}" for i in range(len(keys))]).orderBy(PART, "__kind").rowsBetween(Window.unboundedPreceding, -1)
    carried = heads.unionAll(tails).withColumns({"__before": F.sum("__n").over(earlier), "__last": F.last("__values", ignorenulls=True).over(earlier)})
    carried = carried.where("__kind = 0 AND __before IS NOT NULL").select(F.col(PART).alias("__carried"), "__before", "__last")
    # a row for each part at most
    both = rows.join(F.broadcast(carried), (F.col(PART) == F.col("__carried")) & F.col(HEAD), "left")
    place = F.col(PLACE) + F.coalesce("__before", F.lit(0))
    found = [F.when(F.col(PLACE) == 0, F.col("__last")[n]).otherwise(F.col(f"`{n}`")).alias(n) for n in lags]
    return both.select(*[F.col(n).alias(c) for c, n in names.items()], place.alias(ordinal), *found)
