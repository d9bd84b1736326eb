"""Sums of arrays over all tasks: in pieces, and in levels, so that no group grows with the number of tasks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Arrays travel in so many pieces; a first sum has the pieces of so many tasks.
PIECES, FAN = 64, 512
BLOB = "piece long, task long, weight double, data binary"


def pieces(data: np.ndarray, weight: float, task: int | None = None) -> pa.RecordBatch:
    """An array in PIECES rows: a task's, or that of another number."""
    task = TaskContext.get().partitionId() if task is None else task
    parts = [x.tobytes() for x in np.array_split(data, PIECES)]
    return pa.RecordBatch.from_arrays([pa.array(range(PIECES)), pa.array([task] * PIECES, pa.int64()), pa.array([float(weight)] * PIECES), pa.array(parts, pa.binary())], names=["piece", "task", "weight", "data"])


def gathered(rows: DataFrame, kind: type, mean: bool, fan: int = FAN) -> np.ndarray:
    """All tasks' arrays, `pieces` of each, added up, or their mean by weight: first of `fan` tasks at a time, then
    of those sums; always in the order of tasks, so the same rows give the same bits. Without rows, or without
    weight, it is empty."""

    def combine(table: pa.Table) -> pa.Table:
        table = table.sort_by("task")
        total, weight = None, 0.0
        for data, w in zip(table["data"], table["weight"].to_pylist(), strict=True):
            x = np.frombuffer(data.as_py(), kind)
            x = x * w if mean else x
            total, weight = x if total is None else total + x, weight + w
        total = (total / max(weight, 1e-30) if mean else total).astype(kind)
        return pa.table({"piece": table["piece"][:1], "task": table["task"][:1], "weight": pa.array([weight]), "data": pa.array([total.tobytes()], pa.binary())})

    lots = rows.withColumn("lot", F.floor(F.col("task") / fan)).groupBy("piece", "lot").applyInArrow(lambda t: combine(t.drop_columns("lot")), BLOB)
    found = sorted(lots.groupBy("piece").applyInArrow(combine, BLOB).collect(), key=lambda r: r.piece)
    return np.concatenate([np.frombuffer(r.data, kind) for r in found]) if found and found[0].weight else np.zeros(0, kind)
