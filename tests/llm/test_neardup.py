import random
import re

from fieldloom.llm import neardup
from pyspark.sql import functions as F


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(docs):
    sets = [(d, shingles(t)) for d, t in docs if d is not None]
    parent = {d: d for d, _ in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if x and y and min(len(x), len(y)) * 100 >= 75 * max(len(x), len(y)) and 100 * len(x & y) >= 75 * len(x | y):
                low, high = sorted((root(a), root(b)))
                parent[high] = low
    return {d: root(d) for d in parent}


def check(df, docs):
    rows = neardup.near_duplicates(df).collect()
    want = brute(docs)
    key = lambda r: repr((r[0] is None, r[0] or 0, r[1]))
    assert sorted([(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in rows], key=key) == sorted([(d, len(shingles(t)), want.get(d), want.get(d) == d or d is None) for d, t in docs], key=key)


def test_groups_and_edges(spark):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(4))
    docs = []
    for _ in range(12):
        base = [word() for _ in range(rng.choice([5, 20, 60, 150]))]
        for _ in range(rng.choice([1, 2, 15])):
            edit = list(base)
            for _ in range(rng.randrange(0, 1 + len(base) // 40)):
                edit[rng.randrange(len(edit))] = word()
            docs.append((rng.randrange(10**12), rng.choice([" ", "\n", "\t "]).join(w.upper() if rng.random() < 0.1 else w for w in edit)))
    chain = [word() for _ in range(60)]
    for i in range(12):  # neighbours are links, the ends are not
        docs.append((500 + i, " ".join(chain[i : i + 48])))
    docs += [(1, None), (2, ""), (3, " \n"), (4, "two words"), (5, "Two  words"), (6, "two words more"), (None, docs[0][1]), (None, None), (7, "x " * 30000), (8, "x x x x x x")]
    docs += [(9, docs[0][1]), (9, docs[0][1]), (10, docs[0][1]), (10, docs[-12][1] + " other text"), (11, "É ß é"), (12, "é ß É")]
    df = spark.createDataFrame([(d, t, 1, "k") for d, t in docs], "doc_id long, text string, component_id int, node string")
    check(df, docs)
    assert neardup.near_duplicates(df.limit(0)).count() == 0
    kept = neardup.one_of_each_group(df)
    want = brute(docs)
    assert kept.columns == df.columns and kept.count() == sum(d is None or want[d] == d for d, _ in docs)


def test_whole_table(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    check(df, [tuple(r) for r in df.select("doc_id", "text").collect()])


def test_components_of_random_graphs(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(1000 + i, 1001 + i) for i in range(70)] + [(2000, 2001 + i) for i in range(300)]
    got = {r.node: r.component for r in neardup.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    parent = {}
    root = lambda x: x if parent.setdefault(x, x) == x else root(parent[x])
    for a, b in edges:
        if a != b:
            low, high = sorted((root(a), root(b)))
            parent[high] = low
    assert got == {x: root(x) for x in parent}


def test_large_buckets_are_dealt_to_blocks(spark, monkeypatch):
    n, step = 2500, 100
    rest = spark.range(n).select(F.lit(7).alias("key"), F.col("id").alias("c"), F.lit(10).alias("n"), (F.col("id") % 3).alias("label"), F.lit(1).alias("near"), F.lit(0).alias("far"), F.array(F.lit(7)).alias("keys"))
    monkeypatch.setattr(neardup, "BLOCK_ROWS", step)
    left, right = neardup._block_sides(rest)
    assert left.groupBy("key", "block", "other").count().agg(F.max("count")).first()[0] < 3 * step
    pairs = left.join(right, ["key", "block", "other"]).where("c_a < c_b OR block < other").select(F.least("c_a", "c_b").alias("x"), F.greatest("c_a", "c_b").alias("y")).where("x < y")
    assert pairs.count() == pairs.distinct().count() == n * (n - 1) // 2


def test_small_blocks_give_the_same_groups(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK_ROWS", 2)
    test_groups_and_edges(spark)
