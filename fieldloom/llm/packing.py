"""Packing of tokenised documents into fixed-length sequences."""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from fieldloom.llm.batches import LOWER, SPACES, Texts, texts, words

#: Pieces in a group on average, at most; a group's rows fit one task whatever the input's size.
GROUP_PIECES = 8192
#: Parts of texts whose ids a worker remembers, about 40 bytes each.
CACHE_ENTRIES = 2_000_000
MARK = "\x01"
#: Bytes of text that are looked up at once.
PART_BYTES = 2 << 20
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
SALTED = PIECES + ", salt long"


class CachedTokenizer:
    """Ids of whole texts, equal to the tokenizer's.

    White space ends its word pieces, and so does a full stop or comma between an ASCII letter and white space.
    The parts in between are looked up by their hash (A-Z lower-cased, as the tokenizer does) in a sorted table
    of known parts; only new ones are encoded. A text with "<|" may hold special tokens and is encoded as it is.
    """

    def __init__(self, path: str, entries: int = CACHE_ENTRIES):
        self.tokenizer, self.entries = Tokenizer.from_file(path), entries
        self.mark = self.tokenizer.encode(MARK, add_special_tokens=False).ids
        self._forget()

    def _forget(self) -> None:
        self.key, self.at, self.size, self.flat, self.used = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(1024, np.uint32), 0

    def _learn(self, keys: np.ndarray, parts: list[bytes]) -> None:
        """keys: sorted and new."""
        if len(self.key) > self.entries:
            self._forget()
        ids, size = self._ids(parts)
        total = int(size.sum())
        while self.used + total > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.flat[self.used : self.used + total] = ids
        to = np.searchsorted(self.key, keys)
        self.key, self.at, self.size = np.insert(self.key, to, keys), np.insert(self.at, to, self.used + np.cumsum(size) - size), np.insert(self.size, to, size)
        self.used += total

    def _ids(self, parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all parts, and how many each has. Parts are encoded a thousand at a time, with a mark between
        them that is a token of its own; parts that hold the mark go one by one."""
        if any(MARK.encode() in p for p in parts) or len(self.mark) != 1:
            each = [e.ids for e in self.tokenizer.encode_batch_fast([p.decode() for p in parts], add_special_tokens=False)]
            return np.array([i for ids in each for i in ids], np.uint32), np.array([len(ids) for ids in each])
        joined = [f" {MARK} ".join(p.decode() for p in parts[a : a + 1000]) + f" {MARK}" for a in range(0, len(parts), 1000)]
        ids = np.concatenate([np.array(self.tokenizer.encode_batch_fast([x], add_special_tokens=False)[0].ids, np.uint32) for x in joined])
        ends = np.flatnonzero(ids == self.mark[0])
        return ids[ids != self.mark[0]], np.diff(ends, prepend=-1) - 1

    def encode(self, t: Texts) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and where each text's begin (one more entry than texts)."""
        special = self._special(t)
        if special:
            return self._plain(t, special)
        w = words(t, cut=self._cuts(t))
        unique, place = np.unique(w.hash, return_inverse=True)
        found = np.searchsorted(self.key, unique)
        new = np.ones(len(unique), bool)
        new[found < len(self.key)] = self.key[found[found < len(self.key)]] != unique[found < len(self.key)]
        if new.any():
            if len(self.key) > self.entries:
                self._forget()
                new[:] = True
            sample = np.empty(len(unique), np.int64)
            sample[place] = np.arange(len(place))
            raw = t.buf.tobytes()
            self._learn(unique[new], [raw[w.start[i] : w.end[i]] for i in sample[new].tolist()])
            found = np.searchsorted(self.key, unique)
        at, size = self.at[found][place], self.size[found][place]
        ends = np.concatenate([[0], np.cumsum(size)])
        return self.flat[np.repeat(at - ends[:-1], size) + np.arange(ends[-1])], ends[w.first]

    @staticmethod
    def _cuts(t: Texts) -> np.ndarray:
        """Positions of a full stop or comma that an ASCII letter precedes and white space or the text's end follows."""
        b, last = t.buf, np.zeros(len(t.buf), bool)
        if len(b) < 2:
            return np.zeros(0, np.int64)
        last[:-1] = SPACES[b[1:]]
        last[t.off[1:][t.off[1:] > 0] - 1] = True
        at = np.flatnonzero(last & ((b == 46) | (b == 44)))
        at = at[at > 0]
        before = LOWER[b[at - 1]]
        at = at[(before >= 97) & (before <= 122)]
        return at[~np.isin(at, t.off)]

    @staticmethod
    def _special(t: Texts) -> set[int]:
        mark = np.flatnonzero((t.buf[:-1] == 60) & (t.buf[1:] == 124))
        return set((np.searchsorted(t.off, mark, "right") - 1).tolist())

    def _plain(self, t: Texts, special: set[int]) -> tuple[np.ndarray, np.ndarray]:
        parts = []
        for i in range(len(t)):
            own = t.buf[t.off[i] : t.off[i + 1]]
            ids = np.array(self.tokenizer.encode(own.tobytes().decode(), add_special_tokens=False).ids, np.uint32) if i in special else self.encode(Texts(0, own, np.array([0, len(own)])))[0]
            parts.append(ids)
        return np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])])


@lru_cache(maxsize=2)
def shared_tokenizer(path: str) -> CachedTokenizer:
    """One for all tasks of a Python worker."""
    return CachedTokenizer(path)


def tokenized_pieces(docs: DataFrame, tokenizer: str, length: int, end_id: int) -> DataFrame:
    """A row per piece of at most `length` ids of each document, its end id included. salt tells equal rows of a table
    apart: it is the task's number and how many such rows the task had before, so it is the same in whatever order the
    task's rows come."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, end, seen = shared_tokenizer(tokenizer), end_id.to_bytes(4, "little"), Counter()
        task = TaskContext.get().partitionId() << 40
        for batch in batches:
            doc_ids = batch.column(0)
            for t in texts(batch.column(1), PART_BYTES):
                flat, first = own.encode(t)
                rows: list[list[int]] = [[], [], [], [], [], []]
                ids = doc_ids.slice(t.first, len(t)).to_pylist()
                for i in range(len(t)):
                    tokens = flat[first[i] : first[i + 1]].astype("<u4").tobytes() + end
                    n, same = len(tokens) // 4, hash((ids[i], tokens))
                    salt, seen[same] = task + seen[same], seen[same] + 1
                    for s in range(0, n, length):
                        part = tokens[4 * s : 4 * (s + length)]
                        for to, value in zip(rows, (t.first + i, s, len(part) // 4, zlib.crc32(part), n, salt), strict=True):
                            to.append(value)
                yield pa.RecordBatch.from_arrays([doc_ids.take(pa.array(rows[0])), *(pa.array(r, pa.int64()) for r in rows[1:])], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "salt"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text")).mapInArrow(pieces, SALTED)


def first_fit_decreasing(sizes: list[int], capacity: int) -> list[tuple[int, int]]:
    """(bin, offset) for each of the sizes, which must come in falling order. The tournament tree holds the
    largest free capacity below each node, so the first bin with room is found from the root."""
    leaves = 1
    while leaves < len(sizes):
        leaves *= 2
    tree = [capacity] * (2 * leaves)
    placed = []
    for size in sizes:
        at = 1
        while at < leaves:
            at *= 2
            if tree[at] < size:
                at += 1
        placed.append((at - leaves, capacity - tree[at]))
        tree[at] -= size
        while at > 1:
            at //= 2
            tree[at] = max(tree[2 * at], tree[2 * at + 1])
    return placed


def pack(docs: DataFrame, tokenizer: str | None = None, length: int = 4096, end_id: int = 2, group_pieces: int = GROUP_PIECES, seed: int = 17) -> DataFrame:
    """Packs every document (null text: empty) into sequences of at most `length` ids.

    A document is its ids and then `end_id`, cut every `length` ids. Pieces go to groups at random (by a hash of
    document, ids, salt and seed, so pieces that share a doc_id, or all of it, are dealt out too), about
    `group_pieces` each or fewer, as a text has no more ids than bytes, and every group packs its own by first fit
    decreasing; ties go by doc_id, start and checksum. Repeated rows are packed as often as they occur, a null
    doc_id stays null, an empty text gives one piece with the end id alone, no documents give no rows, and
    columns other than doc_id and text are not looked at.
    """
    pieces = tokenized_pieces(docs, tokenizer or public_tokenizers.path("word_bpe_49k.json"), length, end_id)
    most = docs.agg(F.count(F.lit(1)) + F.coalesce(F.sum(F.floor(F.octet_length("text") / length)), F.lit(0))).first()[0]
    groups = max(1, -(-most // group_pieces))

    def packed(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("length", "descending"), ("doc_id", "ascending"), ("start", "ascending"), ("ids_crc32", "ascending")])
        placed = np.array(first_fit_decreasing(rows["length"].to_pylist(), length), np.int64).reshape(-1, 2)
        sequence = rows["pack_group"].to_numpy() * (1 << 32) + placed[:, 0]
        return rows.drop_columns(["pack_group", "salt"]).append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(placed[:, 1]))

    return (
        pieces.withColumn("pack_group", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32", "doc_tokens", "salt", F.lit(seed)), F.lit(groups)))
        .groupBy("pack_group")
        .applyInArrow(packed, PIECES + ", sequence_id long, offset long")
    )
