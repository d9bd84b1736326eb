import math
import random

import pytest
from fieldloom.functions.geometry import half_up
from fieldloom.operators import features, grid, rules
from pyspark.sql import functions as F

LINK = "frame int, link_id int, tx_x double, tx_y double, tx_z double, rx_x double, rx_y double, rx_z double"


def distance(p, a, b):
    d = [y - x for x, y in zip(a, b, strict=True)]
    size = sum(x * x for x in d)
    t = 0.0 if size <= 1e-12 else max(0.0, min(1.0, sum((q - x) * y for q, x, y in zip(p, a, d, strict=True)) / size))
    return math.dist(p, [x + t * y for x, y in zip(a, d, strict=True)])


@pytest.mark.parametrize("seed,spread", [(1, 2.0), (2, 30.0), (3, 4000.0)])
def test_occupancy_equals_all_pairs(spark, seed, spread):
    rng = random.Random(seed)
    at = lambda s=spread: tuple(rng.uniform(-s, s) for _ in range(3))
    dots = [(f, *at()) for f in (1, 2) for _ in range(400)]
    links = [(f, k, *at(), *at()) for f in (1, 2) for k in range(6)]
    links += [(1, 6, *(p := at()), *p), (2, 7, *at(spread * 3), *at(spread * 3)), (1, 8, 1e6, 1e6, 0.0, 1e6, 1e6, 5.0), (1, 9, *dots[0][1:], *dots[1][1:]), (3, 1, *at(), *at())]
    vertices = spark.createDataFrame([*dots, (1, None, 0.0, 0.0), (2, float("nan"), 0.0, 0.0), (4, 0.0, 0.0, 0.0)], "frame int, x double, y double, z double").repartition(5)
    out = {(r.frame, r.link_id): r for r in features.occupancy(vertices, spark.createDataFrame([*links, (1, 99, *[None] * 6)], LINK), "frame").collect()}
    assert set(out) == {(f, k) for f, k, *_ in links if f != 3} | {(1, 99)}  # without vertices there is no row
    for f, k, *ends in links:
        if f == 3:
            continue
        own = [distance(p, ends[:3], ends[3:]) for g, *p in dots if g == f]
        r = out[f, k]
        assert [r.near_link_0p25m, r.near_link_0p50m, r.near_link_1p00m] == [sum(d <= x for d in own) for x in (0.25, 0.5, 1.0)]
        assert r.near_rx_0p50m == sum(math.dist(p, ends[3:]) <= 0.5 for g, *p in dots if g == f)
        assert r.min_link_distance == pytest.approx(min(own), rel=1e-9) and r.corridor_ratio_0p50m == pytest.approx(r.near_link_0p50m / 401)
    assert (out[1, 99].min_link_distance, out[1, 99].near_link_1p00m) == (None, 0)


def test_few_pairs_are_made(spark):
    rng = random.Random(4)
    dots = spark.createDataFrame([tuple(rng.uniform(0, 100) for _ in range(3)) for _ in range(20_000)], "x double, y double, z double")
    links = spark.createDataFrame([(0, k, *[rng.uniform(0, 100) for _ in range(6)]) for k in range(50)], LINK).drop("frame")
    pairs = grid.near_links(dots, links, [], 1.0)
    assert pairs.groupBy("x", "y", "z", "link_id").count().where("count > 1").count() == 0
    assert 0 < pairs.count() < 20_000 * 50 / 50
    assert features.occupancy(dots.limit(0), links, None).collect() == []
    assert features.occupancy(dots, links.limit(0), None).collect() == []


def plain(rows, text):
    if text is None:
        return "composite"
    for _, kind, pattern, result in sorted((r for r in rows if None not in r[:3]), key=lambda r: (r[0], r[3])):
        low = pattern.lower()
        if {"exact": text == pattern, "contains": low in text.lower(), "startswith": text.lower().startswith(low)}.get(kind, False):
            return result
    return "composite"


@pytest.mark.parametrize("most", [rules.MOST_CHARS, 200])
def test_rule_table_equals_a_loop(spark, most):
    rng = random.Random(6)
    word = lambda n: "".join(rng.choice("abAB é") for _ in range(rng.randrange(n)))
    table = [(rng.randrange(40), rng.choice(["exact", "contains", "startswith", "odd"]), word(5) if k else "", f"r{k}") for k in range(60)][1:] + [(None, "contains", "a", "x"), (0, "contains", None, "y")]
    texts = [word(9) for _ in range(400)] + [None, ""]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").repartition(3)
    out = rules.match_table(df, F.col("t"), spark.createDataFrame(table, "rule_idx int, match_type string, pattern string, result string"), most_chars=most)
    assert {r.k: r.result for r in out.collect()} == {k: plain(table, t) for k, t in enumerate(texts)}
    everything = spark.createDataFrame([(9, "contains", "", "all"), (3, "startswith", "q", "q")], "rule_idx int, match_type string, pattern string, result string")
    assert sorted(r.result for r in rules.match_table(df.where("k >= 399"), F.col("t"), everything).collect()) == ["all", "all", "composite"]


def test_many_rules_in_one_pass_without_a_shuffle(spark):
    table = spark.range(100_000).select(F.col("id").cast("int").alias("rule_idx"), F.lit("contains").alias("match_type"), F.concat(F.lit("part-"), F.hex("id"), F.lit("!")).alias("pattern"), F.concat(F.lit("r"), "id").alias("result"))
    df = spark.range(2000).select("id", F.concat(F.lit("a PART-"), F.hex(F.col("id") * 37), F.lit("! and Part-5!")).alias("t"))
    out = rules.match_table(df, F.col("t"), table)
    assert out.where(F.col("result") != F.concat(F.lit("r"), F.least(F.col("id") * 37, F.lit(5)))).count() == 0
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan


def test_half_up_stays_in_integers(spark):
    r = spark.range(1).select(half_up(F.lit(9007199254740993), F.lit(1)).alias("a"), half_up(F.lit(7), F.lit(2)).alias("b"), half_up(F.lit(10), F.lit(4)).alias("c")).first()
    assert tuple(r) == (9007199254740993, 4, 3)
