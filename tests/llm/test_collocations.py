import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest
from fieldloom.llm import collocations as c
from fieldloom.plans.tables import table

FIELDS = "doc_id long, text string, lang string, n int, rank string"


def plain(rows, least, subsumed=c.SUBSUMED, top=c.TOP):
    counts, totals = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        low = (text or "").translate({x: x + 32 for x in range(65, 91)})
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", low):
            own = re.findall(r"[^ \t]+", piece)
            totals[lang] += len(own)
            for m in range(1, 5):
                counts.update((lang, *own[i : i + m]) for i in range(len(own) - m + 1))
    good = {k: n for k, n in counts.items() if n >= least}
    out = []
    for (lang, *p), a in good.items():
        if len(p) < 2:
            continue
        inside = lambda q: any(list(q[i : i + len(p)]) == p for i in range(len(q) - len(p) + 1))
        if any(k[0] == lang and len(k) - 1 > len(p) and 100 * n >= subsumed * a and inside(k[1:]) for k, n in good.items()):
            continue
        cuts = [(2000000 * a // (good[(lang, *p[:k])] + good[(lang, *p[k:])]), k, good[(lang, *p[:k])], good[(lang, *p[k:])]) for k in range(1, len(p))]
        score, _, left, right = min(cuts)
        out.append((lang, -score, -a, " ".join(p).encode(), left, right))
    ranked = Counter()
    rows = []
    for lang, s, a, p, left, right in sorted(out):
        ranked[lang] += 1
        if ranked[lang] <= top:
            rows.append((lang, ranked[lang], p.decode(), -a, left, right, totals[lang], -s))
    return rows


def found(spark, rows, **more):
    df = spark.createDataFrame([(k, text, lang, 1, "x") for k, (text, lang) in enumerate(rows)], FIELDS).repartition(4)
    return sorted(map(tuple, c.collocations(df, **more).collect()))


def random_rows(seed, n=120):
    rng = random.Random(seed)
    vocabulary = ["a", "A", "b", "ä", "Ä", "new", "york", "city", "\U0001f600", "￿", "é" * 3]
    gaps = [" ", " ", " ", "  ", "\t", ". ", ",", "\n", " ?! ", "\x0b", "\x0c", "\r\n", ":;"]
    return [("".join(rng.choice(vocabulary) + rng.choice(gaps) for _ in range(rng.choice([0, 1, 5, 40]))), rng.choice(["en", "en", "en", "de", None, "und", ""])) for _ in range(n)]


@pytest.mark.parametrize("seed,least", [(1, 3), (2, 10), (3, 1)])
def test_equals_the_plain_version(spark, seed, least):
    rows = random_rows(seed)
    assert found(spark, rows, least=least, top=50) == plain(rows, least, top=50)


def test_equals_the_sql(spark, sf_dir):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    want = con.execute(f"SELECT lang, rank, phrase, a, l, r, n, score FROM ({c.RESULT_SQL})").fetchall()
    got = sorted(map(tuple, c.collocations(table(spark, sf_dir, "documents")).collect()))
    assert got == sorted(want) and len(got) >= 40


def test_crowded_sketches_lose_nothing(spark, monkeypatch):
    rows = random_rows(7)
    want = plain(rows, 4)
    monkeypatch.setattr(c, "MOST_BITS", 4)
    monkeypatch.setattr(c, "LEAST_BITS", 4)
    assert found(spark, rows, least=4) == want


def test_sketches_are_merged_in_levels_and_never_count_less(spark, monkeypatch):
    monkeypatch.setattr(c, "PENDING", 50)
    monkeypatch.setattr(c, "FAN", 2)
    monkeypatch.setattr(c, "PIECE_BITS", 8)
    rows = [(x or "", y) for x, y in random_rows(11)]
    df = spark.createDataFrame(rows, "text string, lang string").repartition(6)
    least, bits = 5, 12
    cells = c.sketched(df, (1, 2), bits, least)
    for sends in (1, 9):
        kept = c.merged(cells, bits, least, sends)
        total = np.zeros((c.DEPTH, 1 << bits), np.int64)
        for r in cells.collect():
            at, n = c._unpacked(r.data)
            d, piece = divmod(r.piece, 1 << (bits - 8))
            total[d, at + (piece << 8)] += n
        assert (np.unpackbits(kept.rows, axis=1, bitorder="little") == (total >= least)).all()


def test_counts_stop_but_keep_the_test(spark):
    rows = [("x y", "en")] * 70_000
    df = spark.createDataFrame(rows, "text string, lang string")
    assert [tuple(r)[:4] for r in c.collocations(df, least=69_000).collect()] == [("en", 1, "x y", 70_000)]


def test_ties_cuts_and_subsumption(spark):
    # "a b" always stands in "a b c", so it goes; "b c" stands alone often enough to stay
    rows = [("a b c", "en")] * 8 + [("b c", "en")] * 3
    assert found(spark, rows, least=5) == plain(rows, 5) == [("en", 1, "b c", 11, 11, 11, 30, 1_000_000), ("en", 2, "a b c", 8, 8, 11, 30, 842_105)]


def test_edges(spark):
    assert found(spark, []) == []
    assert found(spark, [(None, None), ("", "en"), (" .\t", None)], least=1) == []
    long = "to be or not " * 120_000
    assert found(spark, [(long, "en"), (None, "en")]) == plain([(long, "en")], c.LEAST)
    assert found(spark, [("a b", None), ("a b", "und")], least=2) == [("und", 1, "a b", 2, 2, 2, 4, 1_000_000)]
