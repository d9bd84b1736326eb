import zlib

import numpy as np
import pyarrow as pa
from fieldloom.llm import langid
from fieldloom.llm.batches import texts
from pyspark.sql import functions as F


def test_features_are_the_texts_ngrams():
    one = lambda s: langid.features(next(texts(pa.array([s], pa.string()))))
    f, first, has = langid.features(next(texts(pa.array(["Ab é", "", "12 !", "ab  É\n", None], pa.string()))))
    assert has.tolist() == [True, False, False, True, False] and np.diff(first).tolist() == [4, 0, 1, 5, 0]
    assert (f[first[0] : first[1]] == one("Ab é")[0]).all() and (f[first[3] : first[4]] == one("aB é ")[0]).all()


def test_ftrl_separates_and_is_sparse():
    rng = np.random.default_rng(0)
    labels = rng.integers(0, 3, 300)
    rows = [(np.array([k, 10 + rng.integers(100), 1 << langid.BITS]), np.ones(3)) for k in labels]
    w, b = langid.ftrl(rows, labels, 3, l1=0.01)
    assert all((w[at[:-1]].sum(axis=0) + b).argmax() == k for (at, _), k in zip(rows, labels, strict=True))
    assert (w != 0).sum() < 400 and (langid.ftrl(rows, labels, 3, l1=5.0)[0] != 0).sum() < 30


def test_held_out_accuracy_and_edges(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir.replace('sf0.001', 'sf0.01')}/documents.parquet").select("doc_id", "text", "lang")
    extra = spark.createDataFrame([(None, "ist die und", "de"), (-1, None, "en"), (-2, "", "en"), (-3, "12 + ! \n", "en"), (-4, "the of and " * 30000, None), (-5, "the of", "en"), (-5, "the of", "en")], "doc_id long, text string, lang string")
    docs = table.union(extra).withColumn("score", F.lit("clash"))
    model = langid.train(docs)
    rows = langid.identify(docs, model).withColumn("held", langid.held_out()).collect()
    assert len(rows) == docs.count()
    lang = dict(table.select("doc_id", "lang").collect())
    for r in rows:
        assert r.held == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
        assert 0 <= r.score <= 1 and r.lang_pred in {"de", "en", "es", "fr", "und"}
    held = [r for r in rows if r.held and r.doc_id in lang]
    assert np.mean([lang[r.doc_id] == r.lang_pred for r in held]) > 0.97
    by = {r.doc_id: r for r in rows}
    assert [by[i].lang_pred for i in (-1, -2, -3)] == ["und"] * 3 and by[-4].lang_pred == "en"
    assert langid.predicted(docs.limit(0)).count() == 0
    untaught = langid.predicted(docs.withColumn("lang", F.lit(None).cast("string")))
    assert untaught.where("lang_pred <> 'und' OR score <> 0").count() == 0
    kept = langid.with_known_language(docs)
    assert kept.columns == docs.columns and kept.count() >= 0.99 * table.count()


def test_labels_and_ids_are_no_inputs(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = langid.train(docs)
    other = docs.withColumn("lang", F.lit("xx")).withColumn("source", F.lit(None).cast("string"))
    key = lambda df: sorted((r.doc_id, r.lang_pred, round(r.score, 9)) for r in langid.identify(df, model).collect())
    assert key(docs) == key(other)


def test_sums_and_parts_of_long_texts(spark, sf_dir, monkeypatch):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("text IS NOT NULL").select("doc_id", "text")
    want = np.zeros((1 << langid.BITS) + 1, np.int64)
    for r in docs.collect():
        f, _, has = langid.features(next(texts(pa.array([r.text]))))
        if has[0]:
            want[np.unique(f)] += 1
            want[-1] += 1
    assert (langid._document_counts(docs.repartition(3)) == want).all()
    text = "the of and with é " * 500
    (t,) = texts(pa.array([text]))
    ((_, whole),) = langid._counted(t)
    monkeypatch.setattr(langid, "CHARS", 1000)
    ((_, parts),) = langid._counted(t)
    assert (whole == parts).all()
    model = langid.train(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    for cut in (7, 64, 1000):  # also within letters of several bytes and runs of spaces
        for odd in (text, " é\n 1! ö" * 400, "12 " * 900, "a" * 2500, "x" + " " * 3000 + "y"):
            (t,) = texts(pa.array([odd]))
            monkeypatch.setattr(langid, "CHARS", 1 << 18)
            want, there = dict(langid._counted(t)), model.predict(t, judged=True)
            monkeypatch.setattr(langid, "CHARS", cut)
            assert langid._is_long(t)
            found, here = dict(langid._counted(t)), model.predict(t, judged=True)
            assert found.keys() == want.keys() and all((found[i] == want[i]).all() for i in want)
            assert here[0] == there[0] and np.allclose(here[1], there[1]) and np.allclose(here[2], there[2], rtol=1e-3, atol=1e-3)


def test_junk_and_languages_that_were_not_learned_go(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir.replace('sf0.001', 'sf0.01')}/documents.parquet").select("doc_id", "text", "lang")
    rng = np.random.default_rng(3)
    letters = np.array(list("abcdefghijklmnopqrstuvwxyz"))
    junk = [(-1 - i, " ".join("".join(rng.choice(letters, 7)) for _ in range(80)), None) for i in range(20)]
    greek = [(-101 - i, "το είναι και της με για στην από " * 12, None) for i in range(5)]
    kept = {r.doc_id for r in langid.with_known_language(docs.union(spark.createDataFrame(junk + greek, docs.schema))).collect()}
    clean = {r.doc_id for r in docs.where("text rlike '[A-Za-z]'").collect()}
    assert not any(d < 0 for d in kept) and len(clean & kept) >= 0.99 * len(clean)
    two = docs.where("lang IN ('en', 'de')")
    kept = {r.doc_id for r in langid.with_known_language(two.union(spark.createDataFrame(junk + greek, docs.schema))).collect()}
    assert not any(d < 0 for d in kept) and len(kept) >= 0.99 * two.count()


def test_the_sample_is_the_smallest_hashes(spark):
    rows = [(i, "abc " * (1 + i % 3), "en" if i % 3 else "de") for i in range(3000)]
    model = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), per_lang=40)
    assert model.langs == ["de", "en"] and np.isfinite(model.mean).all()


def plain_features(text):
    """n-gram numbers of a text, letter by letter."""
    low = [x.lower() if len(x.lower()) == 1 else x for x in text]
    c = []
    for x, original in zip(low, text, strict=True):
        code = ord(x) if original.isalpha() else 0
        if code or not c or c[-1]:
            c.append(code)
    out = []
    for i in range(len(c)):
        h = 0
        for n in range(langid.ORDERS):
            h = (h + (c[i + n] if i + n < len(c) else 0) + n + 1) * 0x9E3779B1 % 2**32
            h ^= h >> 15
            out.append((h * 0x85EBCA77 % 2**32) >> (32 - langid.BITS))
    return out


def test_predictions_equal_a_plain_version(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = langid.train(docs)
    found = {r.doc_id: r for r in langid.predicted(docs).collect()}
    assert len(found) == docs.count()
    for r in docs.select("doc_id", "text").collect():
        own, got = plain_features(r.text or ""), found[r.doc_id]
        assert got.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
        if not any(x.isalpha() for x in r.text or ""):
            assert (got.lang_pred, got.score) == ("und", 0.0)
            continue
        z = (model.table[own].astype(float).sum(axis=0) / len(own) + model.bias) / model.temperature
        p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
        assert got.lang_pred == model.langs[p.argmax()] and abs(got.score - p.max()) < 1e-4


def test_repeated_rows_and_null_ids_are_learned_from(spark):
    en, de = "the house and the garden of the king", "das haus und der garten von dem koenig"
    schema = "doc_id long, text string, lang string"
    same = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 3 != 1)
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 3 == 1)
    texts_ = [(en, "en"), (de, "de")]
    for rows in (
        [(same, x, lang) for x, lang in texts_] * 2000,  # one doc_id, and a hot row
        [(None, f"{x} {i}", lang) for x, lang in texts_ for i in range(50)],
        [(same, f"{x} {i % 7}", lang) for x, lang in texts_ for i in range(1500)] + [(i, en, "en") for i in range(3)],
    ):
        df = spark.createDataFrame(rows, schema)
        model = langid.train(df, per_lang=40)
        assert model.langs == ["de", "en"]
        out = {(r.lang_pred, r.doc_id) for r in langid.identify(spark.createDataFrame([(1, en, None), (2, de, None)], schema), model).collect()}
        assert out == {("en", 1), ("de", 2)}
    assert langid.train(spark.createDataFrame([(held, en, "en")] * 50, schema)).langs == []


def test_the_sample_is_bounded_and_repeats_do_not_change_it(spark, monkeypatch):
    rows = [(i, f"abc {chr(97 + i % 26)} def {i}", f"l{i % 9}") for i in range(900)]
    schema = "doc_id long, text string, lang string"
    once, often = (langid.train(spark.createDataFrame(x, schema), per_lang=20) for x in (rows, rows + rows[:300] * 3))
    sizes = []
    keep = langid.ftrl
    monkeypatch.setattr(langid, "ftrl", lambda rows, *a, **k: sizes.append(len(rows)) or keep(rows, *a, **k))
    langid.train(spark.createDataFrame(rows + rows[:300] * 3, schema), per_lang=20)
    assert once.langs == often.langs and sizes == [9 * 20 * 4 // 5]
    monkeypatch.setattr(langid, "MOST_LANGS", 3)
    assert len(langid.train(spark.createDataFrame(rows, schema), per_lang=20).langs) == 3
