"""Benchmark decontamination by spaced seeds: masks that ignore some token positions find passages with
substituted words, and every hit's surroundings are compared token by token."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.llm.batches import PUNCTUATION, U, mix64, texts, words

#: Fixed masks, 1: the token counts. Those of LONG are for items of WINDOW words and more, those of SHORT for shorter ones
#: of more than LEAST words; still shorter ones are one mask of ones. Of passages in which as many words agree as must, at any places, nine in ten
#: and more are found at every length and share (the test measures each).
LONG = ("111111", "1111011", "1110111", "11011011", "10101011010", "1101010011", "10010110101", "1100100110001", "1010001100101", "111000101", "1011101", "1100100011")
SHORT = ("10111", "1100101", "10100011", "111001", "1101001")
#: Words of the stretch that must agree (of a shorter item: all its words), the share of them, and how many at least
#: (of a shorter item: all).
WINDOW, SHARE, LEAST = 20, 0.6, 8
#: Hits that are looked at together.
HITS_AT_ONCE = 1 << 20
#: Words of diagonals that are compared together.
WORDS_AT_ONCE = 1 << 22
#: Characters of benchmark text that go to the tasks at once; a larger benchmark is searched part by part.
PART_CHARS = 8_000_000

HITS = "doc_id long, item_id long, start long, end long, agree double"
_Q = [pow(0xA24BAED4963EE407, k + 1, 1 << 64) for k in range(64)]


def _seeds(h: np.ndarray, mask: str) -> np.ndarray:
    """The mask's hash at each position from which it fits."""
    n = max(0, len(h) - len(mask) + 1)
    total = np.zeros(n, U)
    for k, c in enumerate(mask):
        if c == "1":
            total += h[k : k + n] * U(_Q[k])
    return mix64(total)


@dataclass
class SeedIndex:
    """The seeds of benchmark items: sorted hashes, the token position of each, and a bit table before them."""

    hash: np.ndarray
    first: np.ndarray
    item: np.ndarray
    masks: list[str]
    tables: list[tuple[np.ndarray, np.ndarray, np.ndarray]]

    @classmethod
    def of(cls, items: list[tuple[int, str]]) -> SeedIndex | None:
        (t,) = texts(pa.array([x[1] for x in items], pa.large_string()), 1 << 40)
        w = words(t, PUNCTUATION)
        size = np.diff(w.first)
        whole = sorted({int(n) for n in size if 0 < n <= LEAST})
        masks = [*LONG, *SHORT, *("1" * n for n in whole)]
        fit = [size >= WINDOW] * len(LONG) + [(size > LEAST) & (size < WINDOW)] * len(SHORT) + [size == n for n in whole]
        item_of = np.repeat(np.arange(len(size)), size)
        tables = []
        for mask, fits in zip(masks, fit, strict=True):
            s = _seeds(w.hash, mask)
            at = np.arange(len(s))
            inside = (at + len(mask) <= w.first[item_of[: len(s)] + 1]) & fits[item_of[: len(s)]]
            s, at = s[inside], at[inside]
            order = np.argsort(s, kind="stable")
            bits = max(16, int(len(s) * 16).bit_length())
            table = np.zeros(1 << bits, bool)
            table[(s >> U(64 - bits)).astype(np.int64)] = True
            tables.append((s[order], at[order], table))
        return cls(w.hash, w.first, np.array([x[0] for x in items], np.int64), masks, tables) if len(w.hash) else None

    def diagonals(self, h: np.ndarray, first: np.ndarray) -> Iterator[np.ndarray]:
        """Distinct rows (text, item number, offset of the item's first token in the hashes) of all hits, of at most
        HITS_AT_ONCE hits at a time and each diagonal once: what is kept grows with the diagonals, not with the hits."""
        text = np.repeat(np.arange(len(first) - 1), np.diff(first))
        items, low = len(self.first) - 1, len(self.hash)
        span = len(h) + low + 1
        seen = np.zeros(0, np.int64)
        for mask, (seeds, at, table) in zip(self.masks, self.tables, strict=True):
            s = _seeds(h, mask)
            if not len(s) or not len(seeds):
                continue
            bits = len(table).bit_length() - 1
            pos = np.flatnonzero(table[(s >> U(64 - bits)).astype(np.int64)])
            pos = pos[pos + len(mask) <= first[text[pos] + 1]]
            left, n = np.searchsorted(seeds, s[pos], "left"), np.searchsorted(seeds, s[pos], "right")
            n -= left
            ends = np.cumsum(n)
            for a in range(0, int(ends[-1]) if len(ends) else 0, HITS_AT_ONCE):
                k = np.arange(a, min(a + HITS_AT_ONCE, ends[-1]))
                of = np.searchsorted(ends, k, "right")
                which = at[left[of] + k - (ends - n)[of]]
                item = np.searchsorted(self.first, which, "right") - 1
                found = np.unique((text[pos[of]] * items + item) * span + pos[of] - (which - self.first[item]) + low)
                found = found[~np.isin(found, seen, assume_unique=True)]
                seen = np.concatenate([seen, found])
                pair = found // span
                yield np.stack([pair // items, pair % items, found % span - low], 1)

    def verified(self, h: np.ndarray, first: np.ndarray) -> Iterator[tuple[int, int, int, int, float]]:
        """(text, item number, first word, end word, share that agrees) of each diagonal with a stretch of
        WINDOW words (a shorter item: all its words) of which SHARE agree, and LEAST words (a shorter item: all)."""
        for found in self.diagonals(h, first):
            text, item, offset = found.T
            own = self.first[item + 1] - self.first[item]
            begin, end = np.maximum(offset, first[text]), np.minimum(offset + own, first[text + 1])
            full = end - begin >= np.minimum(WINDOW, own)
            for rows in np.array_split(np.flatnonzero(full), 1 + int((end - begin)[full].sum()) // WORDS_AT_ONCE):
                yield from self._agreeing(h, first, *(x[rows] for x in (text, item, offset, begin, end)))

    def _agreeing(self, h: np.ndarray, first: np.ndarray, text: np.ndarray, item: np.ndarray, offset: np.ndarray, begin: np.ndarray, end: np.ndarray) -> Iterator[tuple[int, int, int, int, float]]:
        size = end - begin
        ends = np.cumsum(size)
        each = np.repeat(np.arange(len(size)), size)
        at = np.arange(len(each)) - (ends - size)[each] + begin[each]
        sums = np.concatenate([[0], np.cumsum(h[at] == self.hash[at - offset[each] + self.first[item[each]]])])
        width = np.minimum(WINDOW, self.first[item + 1] - self.first[item])
        k = np.flatnonzero(np.arange(len(each)) + width[each] <= ends[each])
        own = each[k]
        agree = sums[k + width[own]] - sums[k]
        good = agree >= np.maximum(SHARE * width, np.minimum(width, LEAST))[own]
        k, own, agree = k[good], own[good], agree[good]
        start = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]])) if len(own) else np.zeros(0, np.int64)
        last = np.append(start[1:], len(own)) - 1
        most = np.maximum.reduceat(agree, start) if len(start) else agree
        for i, a, b, n in zip(own[start].tolist(), at[k[start]].tolist(), at[k[last]].tolist() if len(start) else [], most.tolist(), strict=True):
            yield int(text[i]), int(item[i]), int(a - first[text[i]]), int(b - first[text[i]] + width[i]), float(n / width[i])


def find_leaks(docs: DataFrame, benchmark: DataFrame, part_chars: int = PART_CHARS) -> DataFrame:
    """(doc_id, item_id, start, end, agree): each stretch of words of a document that a benchmark item covers.

    Words are runs of letters, digits and non-ASCII characters, A-Z lower-cased. Null and empty texts, and items
    without words, match nothing; of an item of LEAST words or fewer all must follow each other. Repeated documents give repeated rows, a null doc_id or
    item_id stays null in the result (null item_ids count as -1), other columns are not looked at. The benchmark
    goes to the tasks in parts whose size is measured first; a larger one takes more passes over the documents.
    """
    items = benchmark.select(F.coalesce(F.col("item_id").cast("long"), F.lit(-1)).alias("item_id"), F.coalesce("text", F.lit("")).alias("text")).where(F.length("text") > 0)
    total = items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    parts = -(-total // part_chars)
    spark, out = docs.sparkSession, None
    for k in range(parts):
        mine = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == k)
        index = SeedIndex.of([tuple(r) for r in mine.collect()]) if parts == 1 or not mine.isEmpty() else None
        if index is None:
            continue
        sent = spark.sparkContext.broadcast(index)

        def find(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            own = sent.value
            for batch in batches:
                for t in texts(batch.column(1)):
                    w = words(t, PUNCTUATION)
                    rows = list(own.verified(w.hash, w.first))
                    if rows:
                        text, item, start, end, agree = map(list, zip(*rows, strict=True))
                        doc = batch.column(0).take(pa.array([t.first + i for i in text]))
                        yield pa.RecordBatch.from_arrays([doc, pa.array(own.item[item]), pa.array(start, pa.int64()), pa.array(end, pa.int64()), pa.array(agree)], names=["doc_id", "item_id", "start", "end", "agree"])

        hits = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(find, HITS)
        out = hits if out is None else out.unionAll(hits)
    return spark.createDataFrame([], HITS) if out is None else out


def judged(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """A row per doc_id: contaminated, the items found (ascending), how many stretches, and the highest share.
    A null doc_id is one more document."""
    hits = find_leaks(docs, benchmark)
    none = F.lit(None)
    all_rows = docs.select(F.col("doc_id").cast("long"), none.cast("long").alias("item_id"), none.cast("double").alias("agree")).unionAll(hits.select("doc_id", "item_id", "agree"))
    return all_rows.groupBy("doc_id").agg(
        (F.count("item_id") > 0).alias("contaminated"), F.sort_array(F.collect_set("item_id")).alias("item_ids"), F.count("item_id").alias("n_stretches"), F.coalesce(F.max("agree"), F.lit(0.0)).alias("agree")
    )


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents, all columns, in which no benchmark item was found. Rows with a null doc_id stay unless one
    of them holds an item."""
    bad = find_leaks(docs, benchmark).select(F.col("doc_id").alias("leaked_doc_id")).distinct()
    return docs.join(bad, F.col("doc_id").cast("long").eqNullSafe(F.col("leaked_doc_id")), "left_anti")
