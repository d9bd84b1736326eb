import hashlib
import math
import random

import duckdb
import numpy as np
import pytest
from fieldloom.llm import codebooks
from fieldloom.plans.tables import table

FIELDS = "vec_id long, embedding array<double>, label int, code string, row int"


def plain(rows):
    """rows: (vec_id, vector, label). The contract, with Python's integers."""
    kept = [(i, [math.floor(4096 * x) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0))
    if not kept:
        return []
    width = len(kept[0][1]) // 8
    books = [[v[p * width : (p + 1) * width] for i, v, _ in kept[:16] if i is not None] for p in range(8)]

    def near(x, book):
        d = [sum((a - b) ** 2 for a, b in zip(x, e, strict=True)) for e in book]
        return d.index(min(d)), min(d)

    for _ in range(6):
        for p in range(8):
            members = [[] for _ in books[p]]
            for _, v, _ in kept:
                x = v[p * width : (p + 1) * width]
                members[near(x, books[p])[0]].append(x)
            books[p] = [[sum(c) // len(m) for c in zip(*m, strict=True)] if m else e for e, m in zip(books[p], members, strict=True)]
    found = [(i, label, [near(v[p * width : (p + 1) * width], books[p]) for p in range(8)]) for i, v, label in kept]
    totals = {}
    for _, label, near_ in found:
        totals[label] = totals.get(label, 0) + sum(e for _, e in near_)
    sha = hashlib.sha256(",".join(str(x) for book in books for e in book for x in e).encode()).hexdigest()
    return [(i, "".join(f"{c:02x}" for c, _ in n), sum(e for _, e in n), totals[label], sha) for i, label, n in found]


def result(df):
    return sorted(map(tuple, codebooks.compressed(df).collect()), key=repr)


def random_rows(n, width, seed):
    rng = random.Random(seed)
    rows = [(k, [rng.choice([rng.gauss(0, 0.2), 0.0, -0.25, 1 / 4096, -1 / 4096]) for _ in range(width)], rng.choice([None, 1, 2])) for k in rng.sample(range(10 * n), n)]
    for k in range(0, n, 3):  # a third are the same
        rows[k] = (rows[k][0], rows[0][1], rows[k][2])
    return rows


@pytest.mark.parametrize("n,width,seed", [(200, 8, 1), (90, 24, 2), (5, 16, 3), (1, 8, 4), (400, 64, 5)])
def test_equals_the_plain_version(spark, n, width, seed):
    rows = random_rows(n, width, seed)
    rows += [(-1, None, 1), (-2, [None] * width, 1), (-3, [float("nan")] * width, 1), (-4, [*[0.0] * (width - 1), float("inf")], 2)]
    df = spark.createDataFrame([(i, v, label, "x", 0) for i, v, label in rows], FIELDS).repartition(5)
    assert result(df) == sorted(plain(rows), key=repr)


def test_equals_the_sql(spark, sf_dir):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf_dir}/embeddings.parquet'")
    order = "vec_id, code, error, label_error, codebooks_sha256"
    want = con.execute(f"SELECT {order} FROM ({codebooks.RESULT_SQL})").fetchall()
    assert result(table(spark, sf_dir, "embeddings")) == sorted(want, key=repr)


def test_hot_parts_and_many_labels_are_joined_otherwise_with_the_same_result(spark, monkeypatch):
    rows = random_rows(300, 16, 9)
    df = spark.createDataFrame([(i, v, label, "x", 0) for i, v, label in rows], FIELDS)
    want = sorted(plain(rows), key=repr)
    monkeypatch.setattr(codebooks, "HOT_LEAST", 5)
    monkeypatch.setattr(codebooks, "HOT_SHARE", 60)
    monkeypatch.setattr(codebooks, "MOST_BROADCAST", 0)
    assert result(df) == want
    monkeypatch.setattr(codebooks, "HOT_LEAST", 10**9)
    assert result(df) == want


def test_nearest_takes_the_first_of_equals():
    code, error = codebooks.nearest(np.array([[0, 0], [3, 4]]), np.array([[1, 0], [-1, 0], [3, 4], [3, 4]]))
    assert (code.tolist(), error.tolist()) == ([0, 2], [1, 0])


def test_floors_go_down():
    import pyarrow as pa

    keep, x = codebooks.integer_rows(pa.array([[-1e-9, 1e-9, -1.0, 0.00048828125], None, [0.0, None, 0.0, 0.0], [1.0], [1e300, -1e300, 0.0, 0.0]], pa.list_(pa.float64())), 4)
    assert keep.tolist() == [True, False, False, False, True]
    assert x[0].tolist() == [-1, 0, -4096, 2] and x[1, 0] == -x[1, 1] == codebooks._limit(4)


def test_edges(spark):
    zero, one = [0.0] * 8, [1.0] * 8
    df = lambda rows: spark.createDataFrame([(i, v, label, "x", 0) for i, v, label in rows], FIELDS)
    assert result(df([])) == []
    assert result(df([(1, None, 1)])) == []
    assert result(df([(1, [0.0] * 9, 1), (2, zero, 1)])) == []  # the first length isn't a multiple of 8
    repeated = result(df([(1, zero, 1), (1, zero, 1), (None, one, None), (2, [0.0] * 16, 1)]))
    assert [r[:3] for r in repeated] == [(1, "00" * 8, repeated[0][2])] * 2 + [(None, "00" * 8, repeated[2][2])]
    assert result(df([(None, one, 1)])) == []  # no vec_id, so no entry
