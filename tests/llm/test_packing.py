import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from fieldloom.llm import batches
from fieldloom.llm.packing import CachedTokenizer, first_fit_decreasing, pack
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

PATH = public_tokenizers.path("word_bpe_49k.json")


@given(st.lists(st.integers(1, 30), max_size=60))
@settings(max_examples=100, deadline=None)
def test_tree_is_first_fit(sizes):
    sizes.sort(reverse=True)
    bins, expected = [], []
    for s in sizes:
        k = next((i for i, b in enumerate(bins) if b + s <= 30), len(bins))
        if k == len(bins):
            bins.append(0)
        expected.append((k, bins[k]))
        bins[k] += s
    assert first_fit_decreasing(sizes, 30) == expected


@given(st.lists(st.text(alphabet=st.sampled_from("aAbé.,'!<|>tTs ΣİÀ́\n\t\x1c\xa0　 9½\x01"), max_size=40), max_size=8))
@settings(max_examples=150, deadline=None)
def test_cached_ids_equal_the_tokenizers(texts):
    plain = Tokenizer.from_file(PATH)
    texts = [*texts, "x <|endoftext|> y<|startoftext|>, it's. DON'T.,"]
    for mine in (texts, texts[:-1]):
        (t,) = batches.texts(pa.array(mine), 1 << 30) if mine else ((),)
        own = CachedTokenizer(PATH)
        for _ in range(2 * bool(mine)):
            flat, first = own.encode(t)
            for i, x in enumerate(mine):
                assert flat[first[i] : first[i + 1]].tolist() == plain.encode(x, add_special_tokens=False).ids


def check(rows, docs):
    plain, pieces, bins = Tokenizer.from_file(PATH), {}, {}
    for r in rows:
        pieces.setdefault(r.doc_id, []).append(r)
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for doc, text in docs.items():
        ids = np.array(plain.encode(text or "", add_special_tokens=False).ids + [2], "<u4")
        at = 0
        for r in sorted(pieces.pop(doc), key=lambda r: r.start):
            assert (r.start, r.doc_tokens) == (at, len(ids))
            assert r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    assert not pieces
    for parts in bins.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 4096
    return len(bins)


def test_pack_edges(spark):
    docs = {1: "One two, three.", 2: None, 3: "", 4: "ab " * 9000, 5: "One two, three.", None: "no id"}
    df = spark.createDataFrame([(k, v, "x") for k, v in docs.items()], "doc_id long, text string, length string")
    check(pack(df, group_pieces=2).collect(), docs)
    assert pack(df.limit(0)).count() == 0
    twice = pack(df.filter("doc_id = 1").union(df.filter("doc_id = 1"))).collect()
    assert len(twice) == 2 and {r.offset for r in twice} == {0, twice[0].length}


def test_rows_that_are_alike_are_dealt_to_all_groups(spark):
    for doc_id in (None, 4):
        df = spark.createDataFrame([(doc_id, "the same") for _ in range(900)], "doc_id long, text string").repartition(3)
        rows = pack(df, group_pieces=30).collect()
        each = np.bincount([r.sequence_id >> 32 for r in rows], minlength=30)
        assert len(rows) == 900 and each.min() > 0 and each.max() < 90


def test_pack_whole_table(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = pack(df).collect()
    n = check(rows, dict(df.select("doc_id", "text").collect()))
    assert sum(r.length for r in rows) > 0.95 * 4096 * (n - 1) or n < 20


if __name__ == "__main__":
    pytest.main([__file__])
