"""Phrase collocations of each language: merged count-min sketches find the runs of words that may be frequent, a
second look counts those exactly, and phrases are scored by their weakest cut and subsumed by longer ones."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldloom.llm.batches import LOWER, Texts, U, Words, mix64, texts, words
from fieldloom.llm.staging import staged

#: Words of the longest phrase; the least count of a phrase; the share of its count, in percent, at which a longer
#: phrase stands for it; phrases of each language that are returned.
LONGEST, LEAST, SUBSUMED, TOP = 4, 30, 80, 2000
#: Rows of a sketch, bytes of text for each of its cells, and the most cells of a row (as powers of two). A larger corpus
#: crowds the cells: more runs are then counted exactly than need be, and none is lost.
DEPTH, BYTES_A_CELL, LEAST_BITS, MOST_BITS = 2, 48, 12, 30
#: Cells of a piece, in which sketches are merged; runs of words that a task counts before it sends their cells;
#: such sends that are merged at once.
PIECE_BITS, PENDING, FAN = 20, 1 << 22, 256
#: In place of a size: words of pairs that may be frequent. Others are in no phrase, so they needn't be counted one by one.
IN_PAIR = 1 << 20
#: Text that is looked at together.
SLICE = 4 << 20
#: The first ranking of a language's phrases is dealt out to so many tasks.
DEALT = 16

MARKS = np.zeros(256, bool)
MARKS[[*b".,;:!?", *range(10, 14)]] = True
GAPS = MARKS.copy()
GAPS[[9, 32]] = True
CELLS = "piece long, send long, data binary"
COUNTED = "lang string, size int, phrase string, n long"
_Q = [pow(0xD6E8FEB86659FD93, k, 1 << 64) for k in range(8)]
_R = [pow(0xA24BAED4963EE407, k + 1, 1 << 64) for k in range(8)]


@dataclass
class Runs:
    """Words of some texts, how many words of its piece are left from each one on, and each one's language: a
    64-bit hash of its name, and a number in the batch."""

    words: Words
    left: np.ndarray
    lang: np.ndarray
    code: np.ndarray

    @classmethod
    def of(cls, t: Texts, lang: np.ndarray, code: np.ndarray) -> Runs:
        """lang, code: of each text."""
        w = words(t, GAPS)
        n = len(w.hash)
        if not n:
            return cls(w, np.zeros(0, np.int64), np.zeros(0, U), np.zeros(0, np.int64))
        text = np.repeat(np.arange(len(t)), np.diff(w.first))
        piece = np.cumsum(MARKS[t.buf])[w.start]
        new = np.flatnonzero((piece[1:] != piece[:-1]) | (text[1:] != text[:-1])) + 1
        ends = np.append(new, n)
        return cls(w, ends[np.searchsorted(ends, np.arange(n), "right")] - np.arange(n), lang[text], code[text])

    def hashes(self, size: int, at: np.ndarray) -> np.ndarray:
        """Of the runs of `size` words that begin with the words `at`; IN_PAIR: of words that are in a pair."""
        total = self.lang[at] + U(size)
        size = 1 if size == IN_PAIR else size
        for k in range(size):
            total += self.words.hash[at + k] * U(_Q[k])
        return mix64(total)

    def seconds(self, size: int, at: np.ndarray) -> np.ndarray:
        """Other hashes of the same runs."""
        total = self.code[at].astype(U)
        for k in range(size):
            total += mix64(self.words.hash[at + k]) * U(_R[k])
        return mix64(total)


def _cells(h: np.ndarray, row: int, bits: int) -> np.ndarray:
    return ((mix64(h ^ U(row * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)) if row else h) >> U(64 - bits)).astype(np.int64)


@dataclass
class Frequent:
    """A bit for each cell of a sketch's rows: set where the merged count is enough."""

    bits: int
    rows: np.ndarray

    def has(self, h: np.ndarray) -> np.ndarray:
        found = np.ones(len(h), bool)
        for d, row in enumerate(self.rows):
            cell = _cells(h, d, self.bits)
            found &= (row[cell >> 3] >> (cell & 7).astype(np.uint8) & 1).astype(bool)
        return found


def _packed(cells: np.ndarray, counts: np.ndarray) -> bytes:
    """Sorted cells of a piece and their counts."""
    data = np.diff(cells, prepend=0).astype("<u4").tobytes() + counts.astype("<u2").tobytes()
    return len(cells).to_bytes(4, "little") + pa.compress(data, "zstd", asbytes=True)


def _unpacked(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = int.from_bytes(data[:4], "little")
    raw = pa.decompress(data[4:], 6 * n, "zstd", asbytes=True)
    return np.cumsum(np.frombuffer(raw, "<u4", n)), np.frombuffer(raw, "<u2", n, 4 * n)


def _batch_langs(batch: pa.RecordBatch) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Names, and each row's hash and number, of the languages (null: und) of rows (lang, text)."""
    coded = batch.column(0).fill_null("und").dictionary_encode()
    names = coded.dictionary.to_pylist()
    hashes = np.array([int.from_bytes(hashlib.blake2b(x.encode(), digest_size=8).digest(), "little") for x in names], U)
    code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    return names, hashes[code] if len(names) else np.zeros(0, U), code


def sketched(docs: DataFrame, sizes: Sequence[int], bits: int, least: int, known: Frequent | None = None) -> DataFrame:
    """(piece, send, data): the cells, with counts that stop at `least`, of all runs of so many words; if pairs of
    words are `known`, only of the words in them and of runs all of whose pairs are. A task sends them again and again."""
    sent = docs.sparkSession.sparkContext.broadcast(known) if known else None
    piece_bits, top = min(PIECE_BITS, bits), min(least, 0xFFFF)

    def rows(pending: list[np.ndarray], number: int) -> Iterator[pa.RecordBatch]:
        h, n = np.unique(np.concatenate(pending), return_counts=True)
        out = []
        for d in range(DEPTH):
            cell = _cells(h, d, bits)
            order = np.argsort(cell, kind="stable") if d else slice(None)
            cell, own = cell[order], n[order]
            start = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
            cell, own = cell[start], np.minimum(np.add.reduceat(own, start), top)
            piece = cell >> piece_bits
            edge = np.flatnonzero(np.concatenate([[True], piece[1:] != piece[:-1]])).tolist()
            for a, b in zip(edge, [*edge[1:], len(cell)], strict=True):
                out.append(((d << (bits - piece_bits)) + int(piece[a]), _packed(cell[a:b] & ((1 << piece_bits) - 1), own[a:b])))
        yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in out], pa.int64()), pa.array([number] * len(out), pa.int64()), pa.array([x for _, x in out], pa.binary())], names=["piece", "send", "data"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pending, fresh, number = [], 0, TaskContext.get().partitionId() << 32
        for batch in batches:
            _, lang, code = _batch_langs(batch)
            for t in texts(batch.column(1), SLICE):
                runs = Runs.of(t, lang[t.first :], code[t.first :])
                pairs = np.zeros(len(runs.left), bool)
                if sent is not None:
                    at = np.flatnonzero(runs.left >= 2)
                    pairs[at] = sent.value.has(runs.hashes(2, at))
                for size in sizes:
                    at = np.flatnonzero(runs.left >= size if size != IN_PAIR else pairs | np.append(False, pairs[:-1])[: len(pairs)])
                    for k in range(size - 1 if sent is not None and size != IN_PAIR else 0):
                        at = at[pairs[at + k]]
                    pending.append(runs.hashes(size, at))
                    fresh += len(at)
                if fresh > PENDING:
                    yield from rows(pending, number)
                    pending, fresh, number = [], 0, number + 1
        if fresh:
            yield from rows(pending, number)

    return docs.select("lang", "text").mapInArrow(count, CELLS)


def merged(cells: DataFrame, bits: int, least: int, sends: int) -> Frequent:
    """The sum of all tasks' sketches, in levels of FAN sends, and where it is `least` or more. A bit for each cell goes
    to the driver: DEPTH rows of 2^MOST_BITS at most."""
    piece_bits, top = min(PIECE_BITS, bits), min(least, 0xFFFF)

    def summed(table: pa.Table) -> np.ndarray:
        total = np.zeros(1 << piece_bits, np.int64)
        for data in table["data"]:
            at, n = _unpacked(data.as_py())
            total[at] = np.minimum(total[at] + n, top)
        return total

    def combine(table: pa.Table) -> pa.Table:
        total = summed(table)
        at = np.flatnonzero(total)
        return pa.table({"piece": table["piece"][:1], "send": table["lot"][:1], "data": pa.array([_packed(at, total[at])], pa.binary())})

    def finish(table: pa.Table) -> pa.Table:
        full = np.packbits(summed(table) >= top, bitorder="little")
        return pa.table({"piece": table["piece"][:1], "send": pa.array([0]), "data": pa.array([full.tobytes()], pa.binary())})

    lots = -(-sends // FAN)
    while lots > 1:
        cells = cells.withColumn("lot", F.pmod(F.xxhash64("send"), F.lit(lots))).groupBy("piece", "lot").applyInArrow(combine, CELLS)
        lots = -(-lots // FAN) if lots > FAN else 1
    rows = np.zeros((DEPTH << (bits - piece_bits), max(1, (1 << piece_bits) // 8)), np.uint8)
    for r in cells.groupBy("piece").applyInArrow(finish, CELLS).collect():
        rows[r.piece] = np.frombuffer(r.data, np.uint8)
    return Frequent(bits, rows.reshape(DEPTH, -1))


def likely_frequent(docs: DataFrame, longest: int = LONGEST, least: int = LEAST) -> Frequent:
    """Runs of two to `longest` words that may stand in `docs` `least` times or more, the words in them, and some others:
    first of pairs, then of longer runs all of whose pairs are among those."""
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    bits = min(MOST_BITS, max(LEAST_BITS, (size // BYTES_A_CELL).bit_length()))
    sends = size // PENDING + 1
    pairs = merged(sketched(docs, [2], bits, least), bits, least, sends)
    more = merged(sketched(docs, [IN_PAIR, *range(3, longest + 1)], bits, least, pairs), bits, least, sends)
    return Frequent(bits, pairs.rows | more.rows)


def _spelled(t: Texts, w: Words) -> tuple[np.ndarray, np.ndarray]:
    """The words, A-Z in lower case, each with one space after it, and where each begins."""
    size = w.end - w.start + 1
    begin = np.concatenate([[0], np.cumsum(size)])
    at = np.repeat(w.start - begin[:-1], size) + np.arange(begin[-1])
    out = LOWER[t.buf[np.minimum(at, max(len(t.buf) - 1, 0))]] if len(t.buf) else np.zeros(0, np.uint8)
    out[begin[1:] - 1] = 32
    return out, begin


def _phrases(spelled: np.ndarray, begin: np.ndarray, at: np.ndarray, size: int) -> pa.Array:
    first, length = begin[at], begin[at + size] - 1 - begin[at]
    ends = np.concatenate([[0], np.cumsum(length)])
    data = spelled[np.repeat(first - ends[:-1], length) + np.arange(ends[-1])]
    return pa.Array.from_buffers(pa.large_string(), len(at), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(data.tobytes())]).cast(pa.string())


def exact_counts(docs: DataFrame, found: Frequent, longest: int = LONGEST, least: int = LEAST) -> DataFrame:
    """(lang, size, phrase, n) of every run of two to `longest` words that stands in its language `least` times or
    more, and of the words in them; with size 0 and an empty phrase each language's words. Only `found` runs leave a task."""
    sent = docs.sparkSession.sparkContext.broadcast(found)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, lang, code = _batch_langs(batch)
            names = pa.array(names, pa.string())
            for t in texts(batch.column(1), SLICE):
                runs = Runs.of(t, lang[t.first :], code[t.first :])
                all_words = np.bincount(runs.code, minlength=len(names))
                some = np.flatnonzero(all_words)
                yield pa.RecordBatch.from_arrays([names.take(pa.array(some)), pa.array([0] * len(some), pa.int32()), pa.array([""] * len(some), pa.string()), pa.array(all_words[some])], names=["lang", "size", "phrase", "n"])
                spelled, begin = _spelled(t, runs.words)
                shorter = np.ones(len(runs.left) + 1, bool)
                for size in range(1, longest + 1):
                    at = np.flatnonzero((runs.left >= size) & shorter[:-1] & (shorter[1:] if size > 1 else True))
                    h = runs.hashes(size if size > 1 else IN_PAIR, at)
                    full = sent.value.has(h)
                    at, h = at[full], h[full]
                    shorter = np.zeros(len(runs.left) + 1, bool)
                    shorter[at] = True
                    if not len(at):
                        break
                    _, first, back, n = np.unique(h, return_index=True, return_inverse=True, return_counts=True)
                    other = runs.seconds(size, at)
                    if (other != other[first][back]).any():  # two runs of one hash
                        _, first, n = np.unique(np.stack([h, other]), axis=1, return_index=True, return_counts=True)
                    at = at[first]
                    yield pa.RecordBatch.from_arrays([names.take(pa.array(runs.code[at])), pa.array(np.full(len(at), size, np.int32)), _phrases(spelled, begin, at, size), pa.array(n)], names=["lang", "size", "phrase", "n"])

    rows = docs.select("lang", "text").mapInArrow(count, COUNTED)
    return rows.groupBy("lang", "size", "phrase").agg(F.sum("n").alias("n")).where((F.col("size") == 0) | (F.col("n") >= least))


def _wide(name: str) -> str:
    return f"CAST({name} AS DECIMAL(20, 0))"


def scored(counts: DataFrame) -> DataFrame:
    """(lang, phrase, a, l, r, score) of every phrase of two words and more: of its weakest cut, of equal ones the first."""
    parts = F.split("phrase", " ")
    cut = lambda first, n: F.array_join(F.slice(parts, first, n), " ")
    cuts = counts.where("size >= 2").select("lang", "size", "phrase", F.col("n").alias("a"), F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", cut(F.lit(1), F.col("k")).alias("first"), cut(F.col("k") + 1, F.col("size") - F.col("k")).alias("rest"))
    one = counts.where("size BETWEEN 1 AND 3") if LONGEST == 4 else counts.where("size >= 1")
    cuts = cuts.join(one.select("lang", F.col("phrase").alias("first"), F.col("n").alias("l")), ["lang", "first"])
    cuts = cuts.join(one.select("lang", F.col("phrase").alias("rest"), F.col("n").alias("r")), ["lang", "rest"])
    score = F.expr(f"(CAST(2000000 AS DECIMAL(7, 0)) * {_wide('a')}) div ({_wide('l')} + {_wide('r')})")
    least = cuts.groupBy("lang", "phrase").agg(F.min(F.struct(score.alias("score"), "k", "l", "r", "a")).alias("c"))
    return least.select("lang", "phrase", "c.a", "c.l", "c.r", "c.score")


def subsuming(counts: DataFrame) -> DataFrame:
    """(lang, phrase, longer): the largest count of a longer phrase in which the phrase's words follow each other."""
    parts = F.split("phrase", " ")
    inner = F.flatten(F.transform(F.sequence(F.lit(2), F.col("size") - 1), lambda n: F.transform(F.sequence(F.lit(1), F.col("size") - n + 1), lambda i: F.array_join(F.slice(parts, i, n), " "))))
    return counts.where("size >= 3").select("lang", F.col("n"), F.explode(F.array_distinct(inner)).alias("phrase")).groupBy("lang", "phrase").agg(F.max("n").alias("longer"))


def collocations(docs: DataFrame, least: int = LEAST, subsumed: int = SUBSUMED, top: int = TOP) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's first `top` phrases of two to four words.

    Texts are lower-cased (A-Z) and cut into pieces at `.,;:!?` and line ends, pieces into words at spaces and tabs.
    n is the number of the language's words, a, l and r how often the phrase and both parts of its weakest cut stand
    in pieces, overlaps included. Phrases that a longer one stands for go. A null text is empty, a null lang is
    `und` as is that name itself; repeated rows count again, doc_id plays no part, no rows give none. Order: score and
    a descending, phrase ascending by bytes. A corpus whose frequent runs are few sends little more than those.
    """
    docs = docs.select("lang", "text")
    counts = staged(exact_counts(docs, likely_frequent(docs, LONGEST, least), LONGEST, least), "phrases")
    kept = scored(counts).join(subsuming(counts), ["lang", "phrase"], "left")
    kept = kept.where(F.expr(f"longer IS NULL OR 100 * {_wide('longer')} < {int(subsumed)} * {_wide('a')}")).drop("longer")
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    dealt = Window.partitionBy("lang", "deal").orderBy(*order)
    first = kept.withColumn("deal", F.pmod(F.xxhash64("phrase"), F.lit(DEALT))).withColumn("rank", F.row_number().over(dealt)).where(F.col("rank") <= top)
    best = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return best.join(counts.where("size = 0").select("lang", "n"), "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def _sql(least: int = LEAST, subsumed: int = SUBSUMED, top: int = TOP) -> str:
    heads = [" || ' ' || ".join(["w", *(f"lead(w, {k}) OVER o" for k in range(1, m))]) for m in range(1, LONGEST + 1)]
    grams = " UNION ALL ".join(f"SELECT lang, {m} AS size, g{m} AS phrase FROM runs WHERE g{m} IS NOT NULL" for m in range(1, LONGEST + 1))
    return f"""
        WITH pieces AS (
            SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents
        ),
        numbered AS (SELECT lang, row_number() OVER () AS piece, list_filter(string_split_regex(piece, '[\\x20\\x09]+'), lambda x: x <> '') AS ws FROM pieces),
        words AS (SELECT lang, piece, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM numbered),
        totals AS (SELECT lang, count(*) AS n FROM words GROUP BY lang),
        runs AS (SELECT lang, {", ".join(f"{h} AS g{m}" for m, h in enumerate(heads, 1))} FROM words WINDOW o AS (PARTITION BY piece ORDER BY i)),
        counts AS (SELECT lang, size, phrase, count(*) AS n FROM ({grams}) GROUP BY ALL HAVING count(*) >= {least}),
        parts AS (SELECT lang, size, phrase, n AS a, string_split(phrase, ' ') AS ws FROM counts WHERE size >= 2),
        cuts AS (SELECT lang, phrase, a, k, array_to_string(ws[1:k], ' ') AS head, array_to_string(ws[k + 1:size], ' ') AS rest FROM (SELECT *, unnest(range(1, size)) AS k FROM parts)),
        priced AS (
            SELECT cuts.lang, cuts.phrase, a, k, l.n AS l, r.n AS r, ((2000000::HUGEINT * a) // (l.n::HUGEINT + r.n)) AS score
            FROM cuts JOIN counts l ON l.lang = cuts.lang AND l.phrase = head JOIN counts r ON r.lang = cuts.lang AND r.phrase = rest
        ),
        weakest AS (SELECT * FROM priced QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
        inner_parts AS (SELECT lang, n, array_to_string(ws[i:i + m - 1], ' ') AS phrase FROM (SELECT lang, a AS n, size, ws, m, unnest(range(1, size - m + 2)) AS i FROM (SELECT *, unnest(range(2, size)) AS m FROM parts))),
        longer AS (SELECT lang, phrase, max(n) AS longer FROM inner_parts GROUP BY ALL),
        kept AS (SELECT weakest.* FROM weakest LEFT JOIN longer USING (lang, phrase) WHERE longer IS NULL OR 100::HUGEINT * longer < {subsumed}::HUGEINT * a),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
        SELECT lang, rank, phrase, a, l, r, n, score::BIGINT AS score FROM ranked JOIN totals USING (lang) WHERE rank <= {top}"""


RESULT_SQL = _sql()
