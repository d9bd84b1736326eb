"""Document fingerprints by consistent weighted sampling of word pairs and their counts."""

from __future__ import annotations

import hashlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldloom.llm.batches import Texts, U, mix64, shingles, texts, words

#: Samples of a fingerprint, each of 16 bits; a term is the 64-bit hash of a run of TERM_WORDS words.
SAMPLES, TERM_WORDS = 128, 2
EMPTY = 0xFFFF
#: Bytes of text that are sampled at once, terms that are drawn for at once, and entries of texts that take them.
CHUNK, TERMS, ENTRIES = 1 << 18, 256, 1024
RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


SALTS = mix64(np.arange(1, SAMPLES + 1, dtype=U) * U(0x9E3779B97F4A7C15))


def _uniform(bits: np.ndarray, width: int) -> np.ndarray:
    return (bits.astype(np.uint32).astype(np.float32) + np.float32(0.5)) * np.float32(2.0**-width)


def _least_a(terms: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """a of each term and sample. With u and v uniform, r = -ln u - ln v is Gamma(2, 1) and the shift ln v / (ln u +
    ln v) is uniform beside it, so a = c u exp(-r t), with t = 0 for a term that occurs once. It depends on the term
    and the weight's step t alone, so the least value of a text also tells which term and step it came from."""
    x = mix64(terms[:, None] ^ SALTS)
    u = _uniform(x >> U(40), 24)
    a = _uniform((x >> U(20)) & U(0xFFFFF), 20)
    a *= _uniform(x & U(0xFFFFF), 20)
    np.log(a, out=a)
    a *= -u
    many = np.flatnonzero(counts > 1)
    if len(many):
        e = -np.log(_uniform(mix64(x[many] + U(1)) >> U(40), 24))
        r = np.maximum(e - np.log(u[many]), np.float32(1e-6))
        a[many] *= np.exp(-r * np.floor((np.log(counts[many]).astype(np.float32)[:, None] + e) / r))
    return a


def weighted_terms(t: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each text's distinct terms, how often they occur, and where each text's begin."""
    values, first = shingles(words(t), TERM_WORDS)
    text = np.repeat(np.arange(len(t)), np.diff(first))
    order = np.lexsort((values, text))
    values, text = values[order], text[order]
    new = np.ones(len(values), bool)
    new[1:] = (values[1:] != values[:-1]) | (text[1:] != text[:-1])
    start = np.flatnonzero(new)
    return values[start], np.diff(np.append(start, len(values))), np.searchsorted(text[start], np.arange(len(t) + 1))


def fingerprints(t: Texts) -> np.ndarray:
    """A row of SAMPLES 16-bit numbers for each text; two rows agree in a share of places that is the generalised
    Jaccard similarity of their term counts, on average. A text without words has EMPTY throughout.

    A term that several of the texts have equally often is drawn for once."""
    out = np.full((len(t), SAMPLES), EMPTY, np.uint16)
    terms, counts, first = weighted_terms(t)
    text = np.repeat(np.arange(len(t)), np.diff(first))
    order = np.lexsort((text, counts, terms))
    terms, counts, text = terms[order], counts[order], text[order]
    new = np.ones(len(terms), bool)
    new[1:] = (terms[1:] != terms[:-1]) | (counts[1:] != counts[:-1])
    start, which = np.flatnonzero(new), np.cumsum(new) - 1
    least = np.full((len(t), SAMPLES), np.inf, np.float32)
    for a in range(0, len(start), TERMS):
        drawn = _least_a(terms[start[a : a + TERMS]], counts[start[a : a + TERMS]])
        low, high = start[a], start[a + TERMS] if a + TERMS < len(start) else len(terms)
        for c in range(low, high, ENTRIES):
            own, at = text[c : min(c + ENTRIES, high)], which[c : min(c + ENTRIES, high)] - a
            by_text = np.argsort(own, kind="stable")
            own = own[by_text]
            edge = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
            some = np.minimum.reduceat(drawn[at[by_text]], edge, axis=0)
            least[own[edge]] = np.minimum(least[own[edge]], some)
    full = np.diff(first) > 0
    out[full] = np.minimum((least[full].view(np.uint32) * np.uint32(0x9E3779B1)) >> np.uint32(16), np.uint32(EMPTY - 1))
    return out


def all_fingerprints(column: pa.Array) -> np.ndarray:
    parts = [fingerprints(t) for t in texts(column, CHUNK)]
    return np.concatenate(parts) if parts else np.zeros((0, SAMPLES), np.uint16)


def edited(text: str, following: str) -> str:
    """`text` with its last quarter replaced by the beginning of the following text."""
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


def _rank(cuts: list[int], value: Column) -> Column:
    """How many of the sorted cuts `value` reaches: by every k-th cut first, then by the k before the next."""
    k = max(1, round(len(cuts) ** 0.5))
    longs = lambda x: F.array(*[F.lit(c).cast("long") for c in x]).cast("array<long>")
    coarse = F.size(F.filter(longs(cuts[::k]), lambda c: c <= value))
    fine = lambda at: (at - 1) * k + F.size(F.filter(F.slice(longs(cuts), (at - 1) * k + 1, k), lambda c: c <= value))
    return F.when(coarse == 0, F.lit(0)).otherwise(fine(F.greatest(coarse, F.lit(1))))


def _range_number(cuts: list[int], place: Column, tie: Column) -> Column:
    """The range of a row. A place that is several cuts, as it has the rows of several ranges, is dealt to as many by
    `tie`, in its order."""
    own = sorted(set(cuts))
    times = [bisect_right(cuts, c) - bisect_left(cuts, c) for c in own]
    if not own:
        return F.lit(0)
    at = _rank(own, place) - 1
    ints = lambda x: F.array(*map(F.lit, x))
    upto, many = F.get(ints(np.cumsum(times).tolist()), at), F.get(ints(times), at)
    share = F.least(F.floor((tie / F.lit(2.0**64) + 0.5) * many).cast("int"), many - 1)
    hot = (many > 1) & (F.get(F.array(*[F.lit(c).cast("long") for c in own]), at) == place)
    return F.when(at < 0, F.lit(0)).when(hot, upto - many + 1 + share).otherwise(upto)


def _ranged(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows (range, last, place, tie, doc_id, text), place being doc_id with nulls first. Each range ends with a row
    (last: true) that repeats the document after it; the last range's is the very first document. There are four
    ranges for each shuffle partition of the session, and of each the driver gets where it begins."""
    spark = docs.sparkSession
    n = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    place, text = F.coalesce(F.col("doc_id"), F.lit(-(2**63))), F.coalesce("text", F.lit(""))
    rows = docs.select(place.alias("place"), F.xxhash64(text).alias("tie"), "doc_id", text.alias("text"))
    cuts = docs.agg(F.percentile_approx(place, [k / n for k in range(1, n)], 20 * n)).first()[0] or []
    rows = rows.withColumn("range", _range_number(sorted(cuts), F.col("place"), F.col("tie")))
    firsts = rows.groupBy("range").agg(F.min(F.struct("place", "tie")).alias("f")).orderBy("range").collect()
    ends = [(r.range, *firsts[(k + 1) % len(firsts)].f) for k, r in enumerate(firsts)]
    tails = F.broadcast(spark.createDataFrame(ends, "tail_range int, tail_place long, tail_tie long"))
    after = rows.join(tails, (F.col("place") == F.col("tail_place")) & (F.col("tie") == F.col("tail_tie"))).groupBy("tail_range", "place", "tie").agg(F.min("text").alias("text"))
    body = rows.select("range", F.lit(False).alias("last"), "place", "tie", "doc_id", "text")
    return body, after.select(F.col("tail_range").alias("range"), F.lit(True).alias("last"), "place", "tie", F.col("place").alias("doc_id"), "text")


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """For each document its fingerprint, that of its edited text, and how like the two and the next document's are.

    The next document is that with the next doc_id, after the last the first; rows with the same doc_id follow
    each other by a hash of their text, and those with a null doc_id come first. A null text is an empty one; texts
    without words are like each other (1) and like no others. No rows give none; other columns are not looked at.
    Documents are sorted in ranges of doc_id, so a text is shuffled once; a doc_id with very many rows is several
    ranges.
    """
    body, tails = _ranged(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    spark = docs.sparkSession
    rows = body.unionAll(tails).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "range").sortWithinPartitions("range", "last", "place", "tie", "text")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, text, last, first = [], [], [], None
        for batch in batches:
            for a in range(0, batch.num_rows, 500):
                part = batch.slice(a, 500)
                ids += part.column("doc_id").to_pylist()
                text += part.column("text").to_pylist()
                last += part.column("last").to_pylist()
                mine = [i for i in range(len(ids) - (not last[-1])) if not last[i]]
                # each text goes beside its edited text, with which it shares most terms
                new = {i: edited(text[i], text[i + 1]) for i in mine}
                both = [(i, k, x) for i in range(len(ids)) for k, x in enumerate((text[i], new.get(i))) if x is not None and (k or i or first is None)]
                prints = dict(zip(((i, k) for i, k, _ in both), all_fingerprints(pa.array([x for _, _, x in both], pa.string())), strict=True))
                if first is not None:
                    prints[0, 0] = first
                if mine:
                    this, changed, following = (np.stack([prints[i + d, k] for i in mine]) for d, k in ((0, 0), (0, 1), (1, 0)))
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([ids[i] for i in mine], pa.int64()),
                            pa.array([len(text[i]) for i in mine], pa.int64()),
                            pa.array([hashlib.sha256(new[i].encode()).hexdigest() for i in mine]),
                            pa.array([x.astype(">u2").tobytes().hex() for x in this]),
                            pa.array([x.astype(">u2").tobytes().hex() for x in changed]),
                            pa.array((this == changed).mean(axis=1)),
                            pa.array((this == following).mean(axis=1)),
                        ],
                        names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
                    )
                first = None if last[-1] else prints[len(ids) - 1, 0]
                ids, text, last = ([], [], []) if last[-1] else (ids[-1:], text[-1:], [False])

    return rows.select("last", "doc_id", "text").mapInArrow(compare, RESULT)
