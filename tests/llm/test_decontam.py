import random
import re

import pytest
from fieldloom.llm import decontam


def split(text):
    return re.findall(r"[A-Za-z0-9\u0080-\U0010ffff]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))


def brute(docs, items):
    """Every alignment of every item: a window of WINDOW words (or the whole item) of which SHARE agree."""
    out = set()
    for doc, text in docs:
        d = split(text)
        for item, passage in items:
            p = split(passage)
            width = min(decontam.WINDOW, len(p))
            need = max(decontam.SHARE * width, min(width, decontam.LEAST))
            if not p:
                continue
            for offset in range(-len(p) + 1, len(d)):
                a, b = max(offset, 0), min(offset + len(p), len(d))
                same = [d[i] == p[i - offset] for i in range(a, b)]
                if any(sum(same[i : i + width]) >= need for i in range(b - a - width + 1)):
                    out.add((doc, item))
    return out


def test_masks_fit_regular_substitutions():
    for step in range(3, 12):
        for shift in range(step):
            good = [i % step != shift for i in range(30)]
            assert any(all(good[i + k] for k, c in enumerate(m) if c == "1") for m in decontam.LONG for i in range(30 - len(m)))


def test_substituted_passages_and_edges(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(3))
    items = [(i, " ".join(word() for _ in range(n))) for i, n in enumerate([30, 25, 40, 12, 6, 4, 1, 20])] + [(8, None), (9, ""), (None, "null item of six whole words"), (7, "twice the same item id other text " * 3)]
    docs = []
    for doc in range(120):
        body = [word() for _ in range(rng.randrange(0, 60))]
        if doc % 3 == 0:
            part = split(items[rng.randrange(len(items))][1])
            step = rng.choice([3, 4, 5, 7, 100])
            body[5:5] = [word() if len(part) > 11 and i % step == 1 else w.upper() + rng.choice(["", ",", "."]) for i, w in enumerate(part)]
        docs.append((doc, " ".join(body)))
    docs += [(-1, None), (-2, ""), (None, items[0][1]), (-3, items[0][1]), (-3, items[0][1]), (-4, "w " * 40000 + items[2][1])]
    df = spark.createDataFrame([(d, t, 0.5) for d, t in docs], "doc_id long, text string, agree double")
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = brute(docs, [(-1 if i is None else i, t) for i, t in items])
    assert len(want) > 25
    for chars in (decontam.PART_CHARS, 200):
        assert {(r.doc_id, r.item_id) for r in decontam.find_leaks(df, bench, chars).collect()} == want
    rows = {r.doc_id: r for r in decontam.judged(df, bench).collect()}
    assert len(rows) == len({d for d, _ in docs}) and {d for d, r in rows.items() if r.contaminated} == {d for d, _ in want}
    assert rows[-3].n_stretches == 2 and rows[-3].item_ids == [0]
    kept = decontam.without_leaks(df, bench)
    assert kept.columns == df.columns and kept.count() == len([d for d, _ in docs if d not in {x for x, _ in want}])
    assert decontam.judged(df.limit(0), bench).count() == 0
    assert decontam.judged(df, bench.limit(0)).where("contaminated").count() == 0


if __name__ == "__main__":
    pytest.main([__file__])


@pytest.mark.parametrize("share", [0.6, 0.7, 0.8, 0.9])
def test_recall_of_random_substitutions_at_every_length(share):
    """Each cell by itself: lengths are not pooled."""
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(5))
    for size in (9, 10, 11, 12, 13, 15, 18, 19, 20, 25, 40):
        items = [(i, " ".join(word() for _ in range(size))) for i in range(400)]
        changed = lambda t: [w if rng.random() < share else word() for w in t.split()]
        docs = [(i, " ".join([word()] * 3 + changed(t) + [word()])) for i, t in items]
        want = {x for d, i in zip(docs, items, strict=True) for x in brute([d], [i])}
        index = decontam.SeedIndex.of(items)
        (t,) = decontam.texts(decontam.pa.array([x for _, x in docs]), 1 << 30)
        w = decontam.words(t, decontam.PUNCTUATION)
        got = {(i, int(index.item[k])) for i, k, *_ in index.verified(w.hash, w.first)}
        assert got <= want and len(want) > 5
        # of few, the share that was found says little
        assert len(got) >= 0.9 * len(want) - (1 if len(want) < 40 else 0), (size, len(got), len(want))


def test_short_items_may_have_substitutions_too():
    """One rule for all lengths: SHARE of the words, and LEAST of them or all."""
    own = "alpha beta gamma delta epsilon zeta eta theta iota kappa".split()
    for size in range(3, 11):
        for gone in range(size):
            items = [(7, " ".join(own[:size]))]
            doc = " ".join(["x", *["other" if i == gone else w for i, w in enumerate(own[:size])], "y"])
            index = decontam.SeedIndex.of(items)
            (t,) = decontam.texts(decontam.pa.array([doc]), 1 << 30)
            w = decontam.words(t, decontam.PUNCTUATION)
            assert bool(list(index.verified(w.hash, w.first))) == (size > decontam.LEAST) == bool(brute([(1, doc)], items))


def test_hits_are_taken_in_parts(monkeypatch):
    items = [(i, f"the same words of all items in the benchmark again and again {i} end of it") for i in range(30)]
    index = decontam.SeedIndex.of(items)
    (t,) = decontam.texts(decontam.pa.array([x for _, x in items] * 2), 1 << 30)
    w = decontam.words(t, decontam.PUNCTUATION)
    whole = sorted(index.verified(w.hash, w.first))
    monkeypatch.setattr(decontam, "HITS_AT_ONCE", 7)
    assert sorted(index.verified(w.hash, w.first)) == whole and len(whole) >= 60
