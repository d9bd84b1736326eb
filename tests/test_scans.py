import random

import pytest
from fieldloom.operators import frames, labels, rounds, scans
from pyspark.sql import functions as F

FIELDS = "k string, h long, o long, v double, w array<int>"


def plain(rows, lag):
    out, seen, before = [], {}, {}
    for r in sorted(rows, key=lambda r: ((r[0] is not None, r[0] or ""), (r[1] is not None, r[1] or 0), (r[2] is not None, r[2] or 0))):
        key = r[:2]
        out.append((*r, seen.get(key, 0), before.get(key)))
        seen[key] = seen.get(key, 0) + 1
        before[key] = r[lag]
    return sorted(map(repr, out))


@pytest.mark.parametrize("seed,hot", [(1, 0.0), (2, 0.4), (3, 1.0)])
def test_equals_a_loop_in_many_parts(spark, seed, hot):
    rng = random.Random(seed)
    rows = [("hot", 1, i, i / 2, [i]) if rng.random() < hot else (rng.choice(["a", "b", None, ""]), rng.choice([1, 2, None]), i, rng.choice([None, 1.5, i / 3]), rng.choice([None, [], [i]])) for i in rng.sample(range(-2000, 2000), 1500)]
    rows += [("only", None, None, 1.0, None)]
    df = spark.createDataFrame(rows, FIELDS).repartition(7)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "23")
    try:
        for lag, name in ((3, "v"), (4, "w")):
            out = scans.numbered(df, ["k", "h"], ["o"], "place", {"before": name})
            assert out.columns == ["k", "h", "o", "v", "w", "place", "before"]
            assert sorted(repr(tuple(r)) for r in out.collect()) == plain(rows, lag)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_one_key_of_a_million_rows_is_many_parts(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        n = 1_000_000
        df = spark.range(n).select(F.lit("rx").alias("rx"), F.pmod(F.col("id") * 7919, F.lit(n)).alias("at"))
        out = scans.numbered(df, ["rx"], ["at"], "place", {"before": "at"})
        bad = out.where((F.col("place") != F.col("at")) | (F.coalesce(F.col("before"), F.lit(-1)) != F.col("at") - 1)).count()
        parts = rounds.settled(df.repartitionByRange("rx", "at").mapInArrow(lambda batches: batches, df.schema)).groupBy(F.input_file_name()).count().collect()
        assert bad == 0 and len(parts) == 16 and max(r["count"] for r in parts) < n / 8
        # equal places are told apart by the other columns, so they too are several parts
        same = scans.numbered(spark.range(200_000).select(F.lit(1).alias("k"), F.lit(1).alias("o"), "id"), ["k"], ["o"], "place")
        assert [tuple(r) for r in same.agg(F.min("place"), F.max("place"), F.count_distinct("place")).collect()] == [(0, 199_999, 200_000)]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_edges(spark):
    empty = spark.createDataFrame([], FIELDS)
    assert scans.numbered(empty, ["k"], ["o"], "place", {"before": "v"}).collect() == []
    one = spark.createDataFrame([(None, None, None, None, None)] * 2, FIELDS)
    assert sorted(r.place for r in scans.numbered(one, ["k"], ["o"], "place").collect()) == [0, 1]
    whole = scans.numbered(spark.createDataFrame([("b", 1, 5, 0.0, None), ("a", 1, 7, 0.0, None)], FIELDS), [], ["o"], "place")
    assert {(r.k, r.place) for r in whole.collect()} == {("b", 0), ("a", 1)}
    dotted = spark.createDataFrame([(1, 2)], "`a.b` int, c int")
    assert scans.numbered(dotted, ["c"], ["c"], "place").columns == ["a.b", "c", "place"]


def test_deltas_and_assembly_over_parts(spark):
    df = spark.createDataFrame([("r", i, float(i * i)) for i in range(50)] + [("s", 1, 2.0)], "r string, t int, v double")
    out = labels.with_deltas(df, "r", ["t"], ["v"]).collect()
    assert sorted((r.t, r.prev_v, r.delta_v) for r in out) == [(i, float((i - 1) ** 2), float(2 * i - 1)) for i in range(1, 50)]
    poses = spark.createDataFrame([("m", "ab"[i % 2], i) for i in range(40)] + [("n", "a", 0), ("n", "a", 1)], "model string, link string, position int")
    wanted = spark.createDataFrame([(m, x) for m in "mn" for x in "ab"], "model string, link string")
    got = frames.assembled(poses, wanted).collect()
    assert {(r.model, r.accepted) for r in got} == {("m", True), ("n", False)}
    assert all(r.sample_index == r.position // 2 for r in got if r.model == "m")


def test_a_cluster_must_name_a_shared_folder(spark, monkeypatch):
    class Conf:
        def get(self, key, default=None):
            return default

    class Session:
        conf = Conf()
        sparkContext = type("Context", (), {"master": "spark://somewhere:7077"})

    with pytest.raises(ValueError):
        rounds.shared_dir(Session())
