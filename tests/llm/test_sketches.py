import hashlib
import random

import numpy as np
import pyarrow as pa
from fieldloom.llm import sketches
from fieldloom.llm.batches import texts
from pyspark.sql import functions as F


def jaccard(a, b):
    of = lambda x: dict(zip(*sketches.weighted_terms(next(texts(pa.array([x]))))[:2], strict=True))
    x, y = of(a), of(b)
    keys = x.keys() | y.keys()
    return sum(min(x.get(k, 0), y.get(k, 0)) for k in keys) / sum(max(x.get(k, 0), y.get(k, 0)) for k in keys)


def test_collisions_are_generalised_jaccard():
    rng = random.Random(9)
    errors, seen = [], []
    for _ in range(60):
        words = [f"w{rng.randrange(30)}" for _ in range(rng.randrange(5, 300))]
        rate = rng.choice([0.3, 0.7, 0.95, 1])
        other = [w if rng.random() < rate else f"w{rng.randrange(60)}" for w in words] + words[: rng.randrange(0, 40)]
        a, b = " ".join(words), " ".join(other)
        fa, fb = sketches.all_fingerprints(pa.array([a, b]))
        seen.append(jaccard(a, b))
        errors.append((fa == fb).mean() - seen[-1])
    assert max(seen) - min(seen) > 0.5 and abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.06


def test_edits_neighbours_and_edges(spark):
    rng = random.Random(2)
    docs = [(rng.randrange(-(2**62), 2**62), " ".join(rng.choice(["aé", "b", "cc", "dd"]) for _ in range(rng.randrange(0, 60)))) for _ in range(400)]
    docs += [(5, None), (6, ""), (7, "abc"), (8, "x " * 40000), (9, "same text here"), (10, "same text here"), (11, "t"), (11, "u"), (None, "no id")]
    df = spark.createDataFrame([(d, t, True, 3) for d, t in docs], "doc_id long, text string, last boolean, range int")
    rows = sketches.edited_fingerprints(df).collect()
    ties = dict(spark.createDataFrame([(t or "",) for _, t in docs], "t string").select("t", F.xxhash64("t")).collect())
    order = sorted(((d is not None, d or 0, ties[t or ""], t or "") for d, t in docs))
    want = {}
    for i, (known, d, _, t) in enumerate(order):
        nxt = order[(i + 1) % len(order)][3]
        n = len(t) // 4
        want.setdefault(d if known else None, []).append((len(t), hashlib.sha256((t[: len(t) - n] + nxt[:n]).encode()).hexdigest()))
    got = {}
    for r in rows:
        got.setdefault(r.doc_id, []).append((r.n_chars, r.edited_sha256))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}
    by = {r.doc_id: r for r in rows}
    assert by[9].fingerprint == by[10].fingerprint and by[9].near_next == 1.0 and by[5].near_next == 1.0 and by[6].near_next == 0.0
    assert by[7].near_edited == 1 and all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in rows)
    assert sketches.edited_fingerprints(df.limit(0)).count() == 0
    one = sketches.edited_fingerprints(df.where("doc_id = 9")).collect()
    assert len(one) == 1 and one[0].near_next == 1.0


def test_a_doc_id_of_very_many_rows_is_several_ranges(spark):
    docs = [(7, f"text number {i}") for i in range(3000)] + [(i, f"other {i}") for i in range(3, 300) if i != 7] + [(7, "the same")] * 40
    df = spark.createDataFrame(docs, "doc_id long, text string")
    ranges = sketches._ranged(df)[0].groupBy("range").count().collect()
    assert len(ranges) > 12 and max(r["count"] for r in ranges) < 1000
    rows = sketches.edited_fingerprints(df).collect()
    assert len(rows) == len(docs)
    ties = dict(df.select("text", F.xxhash64("text")).collect())
    order = sorted((d, ties[t], t) for d, t in docs)
    want = sorted((d, hashlib.sha256(sketches.edited(t, order[(i + 1) % len(order)][2]).encode()).hexdigest()) for i, (d, _, t) in enumerate(order))
    assert sorted((r.doc_id, r.edited_sha256) for r in rows) == want


def test_ranks(spark):
    cuts = [-9, -2, 0, 4, 5, 6, 7, 100, 2**62, 2**63 - 1]
    for some in (cuts, cuts[:1], cuts[:2], cuts[:5]):
        values = [-(2**63), -10, -9, -3, 0, 1, 5, 50, 100, 2**62 + 1, 2**63 - 1]
        got = spark.createDataFrame([(v,) for v in values], "v long").select("v", sketches._rank(some, F.col("v")).alias("k")).collect()
        assert {r.v: r.k for r in got} == {v: sum(c <= v for c in some) for v in values}


def test_whole_table(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = sketches.edited_fingerprints(df).collect()
    assert len(rows) == df.count() and np.mean([r.near_edited for r in rows]) > 0.5 > np.mean([r.near_next for r in rows]) + 0.3


def test_long_texts_are_compared_by_their_word_pairs():
    rng = random.Random(5)
    errors = []
    for shared in (0, 0, 0, 12000):
        a = [f"w{rng.randrange(10**9)}" for _ in range(25000)]
        b = a[:shared] + [f"w{rng.randrange(10**9)}" for _ in range(25000 - shared)]
        x, y = set(zip(a, a[1:], strict=False)), set(zip(b, b[1:], strict=False))
        fa, fb = sketches.all_fingerprints(pa.array([" ".join(a), " ".join(b)]))
        errors.append((fa == fb).mean() - len(x & y) / len(x | y))
    assert max(map(abs, errors[:3])) < 0.03 and abs(errors[3]) < 0.15
