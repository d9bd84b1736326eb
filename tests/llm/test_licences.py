import random
import re

import numpy as np
import pytest
from fieldloom.llm import licences
from fieldloom.plans.tables import table

FIELDS = "doc_id long, text string, labels string, score double, place int"


def plain(text):
    """Words, and the places of each base phrase, without an index."""
    own = re.findall(r"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    found = [(i, label) for phrase, label in licences.BASE for i in range(len(own)) if own[i : i + len(phrase.split())] == phrase.split()]
    starts = [i for i, _ in found]
    return len(own), len(found), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in found}))


def test_base_columns_equal_the_patterns(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    want = {r.doc_id: plain(r.text) for r in docs.select("doc_id", "text").collect()}
    rows = licences.scanned(docs).collect()
    assert len(rows) == docs.count() and sum(r.n_base for r in rows) > 0
    for r in rows:
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == want[r.doc_id]
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) or not r.base_labels
        assert (r.score == 0) == (r.labels == "") and 0 <= r.score <= 1


def test_random_texts_of_license_words(spark):
    rng = random.Random(3)
    vocabulary = "gnu general public license apache cc by nc mit Licence version 2 0 é".split()
    gaps = [" ", "-", ".\n", "  ", " \x0b", "/"]
    rows = [(k, "".join(rng.choice(vocabulary) + rng.choice(gaps) for _ in range(rng.choice([0, 1, 4, 30, 400])))) for k in range(300)]
    out = {r.doc_id: r for r in licences.scanned(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    for k, text in rows:
        r = out[k]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == plain(text), text
    names = {label: phrase.split() for phrase, label in licences.NAMES}
    own = re.findall(r"[a-z0-9é]+", " ".join(x for _, x in rows).lower())
    assert any(own[i : i + 3] == names["cc-by-nc"] for i in range(len(own)))
    for k, text in rows:
        own = re.findall(r"[a-z0-9é]+", text.lower())
        assert ("cc-by-nc" in out[k].labels.split(",")) == any(own[i : i + 3] == names["cc-by-nc"] for i in range(len(own)))


@pytest.mark.parametrize("label,wording,phrases", licences.WORDINGS)
def test_wordings_are_found_with_edits_and_need_their_phrases(label, wording, phrases):
    known = licences.templates()
    vocabulary = licences.licence_words(known)
    index = licences.Index.of(known, vocabulary, np.append(np.arange(len(vocabulary)), len(vocabulary)))

    def labels(*texts):
        h = [licences._hashes(x) for x in texts]
        first = np.concatenate([[0], np.cumsum([len(x) for x in h])])
        out = [set() for _ in texts]
        for i, k, _, _ in licences.find(index, np.concatenate(h), first):
            if known[k].phrases:
                out[i].add(known[k].label)
        return out

    filler = "lorem ipsum dolor sit amet consectetur " * 40
    own = wording.split()
    edited = " ".join([*own[: len(own) // 2], "as", "it", "were", *own[len(own) // 2 :]])
    broken = re.sub(r"[^A-Za-z0-9]+", " ", wording.lower()).replace(phrases[0].split()[1] + " ", "other ")
    whole, kept, gone, half = labels(filler + wording.upper() + filler, "# " + "\n# ".join(own), broken, " ".join(own[: len(own) // 3]))
    assert label in whole and label in kept
    assert label not in half and label not in gone
    if all(p in " ".join(re.findall(r"[a-z0-9]+", edited.lower())) for p in phrases):
        assert label in labels(edited)[0]
    assert labels(filler * 3)[0] == set()


def test_rarity_decides_where_not_what(spark):
    known = licences.templates()
    vocabulary = licences.licence_words(known)
    text = licences._hashes("released under the MIT license and the Apache License, Version 2.0; cc by")
    found = []
    for seed in range(4):
        counts = np.append(np.random.default_rng(seed).integers(0, 100, len(vocabulary)), 100)
        found.append(sorted(licences.find(licences.Index.of(known, vocabulary, counts), text, np.array([0, len(text)]))))
    assert all(f == found[0] for f in found) and len(found[0]) == 4


def test_counts_are_of_rows(spark):
    known = licences.templates()
    vocabulary = licences.licence_words(known)
    rows = [(1, "gnu gnu MIT"), (1, None), (None, ""), (2, "Gnu")]
    counts = licences.document_counts(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), vocabulary)
    at = lambda x: counts[np.searchsorted(vocabulary, licences._hashes(x)[0])]
    assert (at("gnu"), at("mit"), at("apache"), counts[-1]) == (2, 1, 0, 4)


def test_edges(spark):
    long = "word " * 300_000 + "apache license " + "word " * 10
    rows = [(1, None, "a", 0.5, 3), (1, None, "a", 0.5, 3), (2, "", None, None, None), (None, "MIT License", "b", 1.0, 1), (3, long, "c", 0.0, 2), (4, "mit", "d", 0.0, 2), (5, "license", "d", 0.0, 2)]
    out = licences.scanned(spark.createDataFrame(rows, FIELDS)).collect()
    assert len(out) == 7 and len(out[0]) == 8
    by = {r.doc_id: r for r in out}
    assert (by[1].n_words, by[1].n_base, by[1].first_word, by[1].labels, by[1].score) == (0, 0, None, "", 0.0)
    assert (by[None].base_labels, by[None].first_word, by[None].score) == ("mit", 0, 1.0)
    assert (by[3].first_word, by[3].last_word, by[3].n_words) == (300_000, 300_000, 300_012)
    assert by[4].n_base == by[5].n_base == 0  # a phrase doesn't cross documents
    assert licences.scanned(spark.createDataFrame([], FIELDS)).collect() == []
    kept = licences.without_labels(spark.createDataFrame(rows, FIELDS), ["apache"])
    assert sorted((r.doc_id or 0) for r in kept.collect()) == [0, 1, 1, 2, 4, 5] and kept.columns == ["doc_id", "text", "labels", "score", "place"]
