import hashlib
import random

import numpy as np
import pyarrow as pa
from fieldloom.llm import suffixes
from hypothesis import given, settings
from hypothesis import strategies as st


def brute(docs):
    rows = sorted(((d, (t or "").encode()) for d, t in docs), key=lambda x: (x[0] is None, x[0] or 0))
    first = {}
    for d, b in rows:
        if d is not None:
            for i in range(len(b) - 49):
                first.setdefault(b[i : i + 50], d)
    out = []
    for d, b in rows:
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - 49):
            if d is not None and first[b[i : i + 50]] < d:
                gone[i : i + 50] = True
        runs = sum(gone[i] and not (i and gone[i - 1]) for i in range(len(b)))
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out.append((d, len(b), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def got(df):
    return sorted((tuple(r) for r in suffixes.without_repeats(df).collect()), key=repr)


@given(st.lists(st.binary(min_size=50, max_size=50).map(lambda b: bytes(x % 2 for x in b)), min_size=1, max_size=40), st.integers(0, 3))
@settings(max_examples=60, deadline=None)
def test_groups_are_equal_strings(strings, copies):
    strings = [s[:40] + strings[0][40:] for s in strings] + strings * copies
    m = np.frombuffer(b"".join(strings), np.uint8).reshape(-1, 50)
    g = suffixes.msd_groups(m, np.zeros(len(m), np.int64))
    for i, a in enumerate(strings):
        for j, b in enumerate(strings[:i]):
            assert (a == b) == (g[i] == g[j] >= 0)


def test_planted_repeats_and_edges(spark):
    rng = random.Random(4)
    text = lambda n, letters="abcdefghijklmnop é": "".join(rng.choice(letters) for _ in range(n))
    passages = [text(rng.choice([30, 49, 50, 51, 60, 120, 400])) for _ in range(10)]
    docs = []
    for i in range(150):
        parts = [text(rng.randrange(0, 80)) for _ in range(3)]
        for _ in range(rng.randrange(0, 3)):
            p = rng.choice(passages)
            a = rng.randrange(0, 20)
            parts.insert(rng.randrange(4), p[a : len(p) - rng.randrange(0, 20)])
        docs.append((rng.randrange(-(2**62), 2**62) if i % 2 else i, "".join(parts)))
    docs += [(d + 1000, t) for d, t in docs[:20]]
    docs += [(900 + i, text(rng.randrange(40, 200), "ab")) for i in range(20)] + [(950, "a" * 300), (951, "a" * 200), (952, "ab" * 100), (953, "a" * 49), (954, "a" * 50)]
    docs += [(960, None), (961, ""), (962, passages[0] * 30), (963, passages[0] * 31), (None, passages[0]), (None, None), (964, text(70)), (965, text(3_000) * 2)]
    docs += [docs[3], docs[3], (docs[5][0], docs[6][1]), (docs[5][0], docs[7][1])]
    df = spark.createDataFrame([(d, t, 1, "x") for d, t in docs], "doc_id long, text string, key int, row string")
    assert got(df) == brute(docs)
    names = "BLOCK_BYTES", "BUCKET_BYTES", "HOT_SENT", "HOT_OPEN"
    before = [getattr(suffixes, n) for n in names]
    try:
        for values in ((4000, 7000, *before[2:]), (4000, 7000, 3, 5), (4000, 7000, before[2], 2), (before[0], before[1], 2, before[3])):
            for n, v in zip(names, values, strict=True):
                setattr(suffixes, n, v)
            assert got(df) == brute(docs)
    finally:
        for n, v in zip(names, before, strict=True):
            setattr(suffixes, n, v)
    assert suffixes.without_repeats(df.limit(0)).count() == 0


def test_a_passage_in_every_document(spark):
    """Its windows are found, and what is sent for one gram doesn't grow with the documents that have it."""
    rng = random.Random(6)
    text = lambda n: "".join(rng.choice("abcdefghijklmnop ") for _ in range(n))
    passage = text(130)
    docs = [(i, text(60) + passage + text(60)) for i in range(600)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert got(df) == brute(docs)
    batch = pa.RecordBatch.from_pydict({"doc": pa.array([d for d, _ in docs]), "row": pa.array([d for d, _ in docs]), "text": pa.array([t for _, t in docs])})
    rows = [r for b in suffixes._send_suffixes(1, 1, suffixes.HOT_SENT)(iter([batch])) for r in b.to_pylist()]
    sent = sum(r["tag"] for r in rows if r["kind"] == suffixes.SUFFIX)
    grams = np.concatenate([np.frombuffer(r["data"], np.uint32, r["tag"]) for r in rows if r["kind"] == suffixes.SUFFIX])
    assert 0 < sent and np.unique(grams, return_counts=True)[1].max() <= suffixes.HOT_SENT


def test_whole_table(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(120)
    docs = [tuple(r) for r in df.select("doc_id", "text").collect()]
    assert got(spark.createDataFrame(docs, "doc_id long, text string")) == brute(docs)
