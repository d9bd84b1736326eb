"""Masked pseudo-likelihood: a window network predicts every word from the words on both sides.

Words are the leaves of a tree. A word's last two bytes lead to one of BRANCHES branches, each of which has as many
twigs; a branch's most frequent words have a twig of their own, the others share the rest of the twigs by their last
three bytes. The network gives a probability to each branch and, in it, to each twig, both from the words on both
sides; a word's share of its twig is that of its exact count in the corpus. There are about TWIGS times as many twigs as
the root of the number of distinct words, so the tree grows with the corpus.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldloom.llm.batches import LOWER, SLICE_BYTES, Texts, U, mix64, texts, words
from fieldloom.llm.staging import staged
from fieldloom.llm.sums import BLOB, gathered, pieces

BRANCHES, TWIGS = 128, 2
#: At most so many words' counts go to every task; those of the others, none of which is frequent, are joined.
KNOWN = 1 << 18
#: Slots of their hashes.
SLOTS = 1 << 20
#: Words on each side, and the width of the hidden layer.
SIDE, HIDDEN = 2, 32
#: Each round learns from every ROUNDS-th word of every document, each time others: from every word once.
ROUNDS = 2
#: The corpus gives about so many steps, if those then have no more than so many words each; the rate of learning for
#: steps of 2048 words and fewer.
STEPS, BATCH, RATE = 2000, 8192, 0.05
#: The scores of all branches are held for so many words at once, which a core's cache has room for.
CACHED = 1024
#: So many rows of a run are added up one after another.
RUN = 24
#: Words of a learner.
LEARNER_WORDS = 1 << 21
#: A task's distinct words are sent on when there are more.
PENDING = 1 << 20
COUNTS = "word long, ending long, n long"
NUMBERED = "row long, doc_id long, place long, size long, twigs binary, n_tokens long, share double, once long, rest array<long>"
JUDGED = "row long, doc_id long, n_tokens long, part double, once long"


def _sorted(numbers: np.ndarray, most: int) -> np.ndarray:
    """The order of numbers below `most`; sorts of 16 bits are faster."""
    return np.argsort(numbers.astype(np.uint16) if most <= 1 << 16 else numbers, kind="stable")


def word_numbers(t: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each word's 64-bit hash, its last three bytes, and where each text's words begin."""
    w = words(t)
    ending = np.zeros(len(w.hash), np.int64)
    for k in range(3):
        at = w.end - 1 - k
        ending |= np.where(at >= w.start, LOWER[t.buf[np.maximum(at, 0)]], 0).astype(np.int64) << (8 * k)
    return w.hash.view(np.int64), ending, w.first


def _branch(ending: np.ndarray) -> np.ndarray:
    return (mix64((ending & 0xFFFF).astype(U)) >> U(40)).astype(np.int64) % BRANCHES


def _shared_twig(ending: np.ndarray, single: int, twigs: int) -> np.ndarray:
    """The twig, among those that words share, to which an ending leads; twigs of one branch follow each other."""
    return _branch(ending) * twigs + single + (mix64(ending.astype(U) + U(1 << 32)) >> U(40)).astype(np.int64) % (twigs - single)


def run_sums(x: np.ndarray, at: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The rows `at` of x, added up in runs of `count` rows: RUN of a run at a time, whole rows of all runs at once, and then
    those sums in the same way."""
    while True:
        parts = -(-count // RUN)
        last = np.cumsum(parts) - 1
        size = np.full(last[-1] + 1 if len(last) else 0, RUN)
        size[last] = count - (parts - 1) * RUN
        # the longest first, so that those with another row are always the first ones
        order = np.argsort((RUN - size).astype(np.uint8), kind="stable")
        place = (np.cumsum(size) - size)[order]
        longer = len(size) - np.cumsum(np.bincount(size, minlength=RUN + 1))
        total = np.take(x, at[place], axis=0, mode="clip")
        more = np.empty_like(total)
        for r in range(1, RUN):
            some = int(longer[r])
            place += 1
            total[:some] += np.take(x, at[place[:some]], axis=0, mode="clip", out=more[:some])
        more[order] = total
        if len(parts) == len(size):
            return more
        x, at, count = more, np.arange(len(size)), parts


@dataclass
class Vocabulary:
    """The most frequent words, sorted, with twig and count; `sums`: of each twig, the sum of its words' counts and a
    half for each of them and for all words that were not counted; `total`: all counts. `counts` (word, n) has every word, if some are
    not among the known."""

    words: np.ndarray
    twig: np.ndarray
    n: np.ndarray
    twigs: int
    single: int
    sums: np.ndarray
    total: int
    counts: DataFrame | None = None

    slots: np.ndarray | None = None

    @property
    def kind(self) -> np.dtype:
        """In which a table has twigs."""
        return np.dtype(np.uint16 if self.twigs * BRANCHES <= 1 << 16 else np.uint32)

    def sent(self) -> Vocabulary:
        """What tasks need."""
        return replace(self, counts=None, slots=None)

    def of(self, number: np.ndarray, ending: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each word's twig, and its count, -1 if that isn't known here. Most are found by the slot of their hash, which
        the most frequent of its words has; the others are searched for."""
        if not len(self.words):
            return _shared_twig(ending, self.single, self.twigs), np.full(len(number), -1)
        if self.slots is None:
            self.slots = np.zeros(SLOTS, np.int32)
            order = np.argsort(self.n, kind="stable")
            self.slots[self.words[order] & (SLOTS - 1)] = order
        at = self.slots[number & (SLOTS - 1)].astype(np.int64)
        left = np.flatnonzero(self.words[at] != number)
        at[left] = np.minimum(np.searchsorted(self.words, number[left]), len(self.words) - 1)
        twig, n = self.twig[at], self.n[at]
        left = left[self.words[at[left]] != number[left]]
        twig[left], n[left] = _shared_twig(ending[left], self.single, self.twigs), -1
        return twig, n


class Network:
    """Scores of branches and twigs from the twigs of 2 * SIDE neighbours: summed tables, tanh, and a linear layer for
    the branches and for each branch's twigs."""

    def __init__(self, flat: np.ndarray, twigs: int):
        self.twigs, self.groups = twigs, twigs * BRANCHES
        self.flat = np.ascontiguousarray(flat, np.float32)
        shapes = self.shapes(twigs)
        ends = np.cumsum([int(np.prod(s)) for s in shapes])
        self.near, self.bias, self.out, self.prior, self.inner = (x.reshape(s) for x, s in zip(np.split(self.flat, ends[:-1]), shapes, strict=True))
        #: The branches' scores and, as its last row, their constants.
        at = self.near.size + HIDDEN
        self.layer = self.flat[at : at + (HIDDEN + 1) * BRANCHES].reshape(HIDDEN + 1, BRANCHES)
        self.steps = None

    @staticmethod
    def shapes(twigs: int) -> tuple[tuple[int, ...], ...]:
        return (2 * SIDE * (twigs * BRANCHES + 1), HIDDEN), (HIDDEN,), (HIDDEN, BRANCHES), (BRANCHES,), (BRANCHES, twigs, HIDDEN + 1)

    @classmethod
    def of(cls, known: Vocabulary) -> Network:
        """Not yet taught: whatever the neighbours, words have the probabilities of their counts in the corpus."""
        net = cls(np.zeros(sum(int(np.prod(s)) for s in cls.shapes(known.twigs)), np.float32), known.twigs)
        net.near[:] = np.random.default_rng(11).standard_normal(net.near.shape) * 0.3
        sums = known.sums.reshape(BRANCHES, known.twigs)
        net.inner[:, :, HIDDEN] = np.log(sums / sums.sum(axis=1, keepdims=True))
        net.prior[:] = np.log(sums.sum(axis=1) / sums.sum())
        return net

    def neighbours(self, twig: np.ndarray, first: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Rows of `near` for the words `at`; a place beyond the text has a row of its own."""
        wide, place = self.spread(twig, first)
        return self.around(wide, place[at])

    def spread(self, twig: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The words with SIDE places beyond a text before the first text and after each, and where each word stands there."""
        count = np.diff(first)
        place = np.arange(len(twig)) + SIDE * (1 + np.repeat(np.arange(len(count)), count))
        wide = np.full(len(twig) + SIDE * (1 + len(count)), self.groups)
        wide[place] = twig
        return wide, place

    def around(self, wide: np.ndarray, place: np.ndarray) -> np.ndarray:
        """`neighbours` of the words that stand at `place` in `wide`."""
        out = np.empty((len(place), 2 * SIDE), np.int64)
        for k, shift in enumerate([*range(-SIDE, 0), *range(1, SIDE + 1)]):
            np.add(np.take(wide, place + shift, mode="clip"), k * (self.groups + 1), out=out[:, k])
        return out

    def hidden(self, rows: np.ndarray) -> np.ndarray:
        """With a last column of ones, for the layers' constants."""
        total = np.empty((len(rows), HIDDEN + 1), np.float32)
        x = np.take(self.near, rows[:, 0], axis=0, mode="clip")
        more = np.empty_like(x)
        for k in range(1, rows.shape[1]):
            x += np.take(self.near, rows[:, k], axis=0, mode="clip", out=more)
        x += self.bias
        np.tanh(x, out=total[:, :HIDDEN])
        total[:, HIDDEN] = 1
        return total

    def _within_reach(self) -> bool:
        """Whether no score of a branch can leave the range of exponentials, nor all of a word's: what is hidden is
        between -1 and 1. Then a word's largest score need not be taken off."""
        reach = np.abs(self.out).sum(axis=0)
        return bool((self.prior + reach).max() < 80 and (self.prior - reach).max() > -80)

    def _branches(self, h: np.ndarray, branch: np.ndarray, near: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The exponentials of all branches' scores, the score of each word's own, and the sums of the exponentials."""
        p = h @ self.layer
        if not near:
            p -= p.max(axis=1, keepdims=True)
        own = p[np.arange(len(p)), branch]
        np.exp(p, out=p)
        return p, own, p @ np.ones(BRANCHES, np.float32)

    def _twigs(self, h: np.ndarray, runs: list[tuple[int, int, int]], leaf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The same of the twigs of each word's branch, a row for each twig."""
        q = np.empty((self.twigs, len(h)), np.float32)
        for b, first, end in runs:
            np.matmul(self.inner[b], h[first:end].T, out=q[:, first:end])
        q -= q.max(axis=0)
        own = q[leaf, np.arange(len(h))]
        np.exp(q, out=q)
        return q, own, q.sum(axis=0)

    @staticmethod
    def _runs(branch: np.ndarray) -> list[tuple[int, int, int]]:
        """(branch, first, end) of the runs of sorted branches."""
        edge = np.flatnonzero(np.concatenate([[True], branch[1:] != branch[:-1]]))
        return list(zip(branch[edge].tolist(), edge.tolist(), [*edge[1:].tolist(), len(branch)], strict=True)) if len(branch) else []

    def log_probs(self, rows: np.ndarray, twig: np.ndarray) -> np.ndarray:
        """Of each word's branch and twig together."""
        order = _sorted(twig, self.groups)
        h, own, near = self.hidden(rows[order]), twig[order], self._within_reach()
        branch, total = own // self.twigs, np.empty(len(own))
        _, score, whole = self._twigs(h, self._runs(branch), own % self.twigs)
        found = score - np.log(whole)
        for a in range(0, len(own), CACHED):
            _, score, whole = self._branches(h[a : a + CACHED], branch[a : a + CACHED], near)
            found[a : a + CACHED] += score - np.log(whole)
        total[order] = found
        return total

    def gradient(self, rows: np.ndarray, twig: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        """Of the mean negative logarithm: the named rows of `near`, their gradient, and those of the other layers."""
        order = _sorted(twig, self.groups)
        rows, own = rows[order], twig[order]
        n, branch, leaf, each = np.float32(len(own)), own // self.twigs, own % self.twigs, np.arange(len(own))
        h, runs, reach = self.hidden(rows), self._runs(branch), self._within_reach()
        back, layer, inner = np.empty((len(own), HIDDEN), np.float32), np.zeros_like(self.layer), np.zeros_like(self.inner)
        out = np.ascontiguousarray(self.out.T)
        for a in range(0, len(own), CACHED):
            some, mine = h[a : a + CACHED], branch[a : a + CACHED]
            p, _, whole = self._branches(some, mine, reach)
            p[each[: len(mine)], mine] -= whole
            whole *= n
            layer += (some / whole[:, None]).T @ p
            np.divide(p @ out, whole[:, None], out=back[a : a + CACHED])
        q, _, whole = self._twigs(h, runs, leaf)
        q[leaf, each] -= whole
        q /= whole * n
        for b, first, end in runs:
            some = q[:, first:end]
            np.matmul(some, h[first:end], out=inner[b])
            back[first:end] += some.T @ self.inner[b, :, :HIDDEN]
        back *= 1 - h[:, :HIDDEN] ** 2
        flat = rows.ravel()
        order = _sorted(flat, len(self.near))
        flat = flat[order]
        start = np.flatnonzero(np.concatenate([[True], flat[1:] != flat[:-1]]))
        near = run_sums(back, order // rows.shape[1], np.diff(np.append(start, len(flat))))
        return flat[start], near, [back.sum(axis=0), layer[:HIDDEN], layer[HIDDEN], inner]

    def learn(self, rows: np.ndarray, twig: np.ndarray, rate: float) -> None:
        """A step down the gradient, each weight at a rate by the sum of its squared gradients so far (Adagrad)."""
        at, near, rest = self.gradient(rows, twig)
        layers = [self.bias, self.out, self.prior, self.inner]
        if self.steps is None:
            self.steps = [np.full_like(x, 1e-6) for x in (self.near, *layers)]
        squares = self.steps[0][at] + near * near
        self.steps[0][at] = squares
        self.near[at] -= rate * near / np.sqrt(squares)
        for layer, total, g in zip(layers, self.steps[1:], rest, strict=True):
            total += g * g
            layer -= rate * g / np.sqrt(total)


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, ending, n): every word number of every text, its last bytes, and how often it occurs."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.zeros(0, np.int64)
        found, waiting, fresh = (none, none, none), [], 0

        def merged() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            word, ending, n = (np.concatenate([found[i], *(x[i] for x in waiting)]) for i in range(3))
            both, at, back = np.unique(word, return_index=True, return_inverse=True)
            return both, ending[at], np.bincount(back, n, len(both)).astype(np.int64)

        def sent() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x) for x in found], names=["word", "ending", "n"])

        for batch in batches:
            for t in texts(batch.column(0)):
                number, ending, _ = word_numbers(t)
                number, at, n = np.unique(number, return_index=True, return_counts=True)
                waiting.append((number, ending[at], n))
                fresh += len(number)
                if fresh > PENDING:
                    found, waiting, fresh = merged(), [], 0
                    if len(found[0]) > PENDING:
                        yield sent()
                        found = none, none, none
        found = merged()
        yield sent()

    return docs.select("text").mapInArrow(count, COUNTS).groupBy("word").agg(F.min("ending").alias("ending"), F.sum("n").alias("n"))


def vocabulary(docs: DataFrame) -> Vocabulary:
    """Counts every word of every text. Words with the same count and branch are taken by their number."""
    counts = staged(word_counts(docs), "words")
    by_count = np.array(sorted(map(tuple, counts.groupBy("n").count().collect()), reverse=True), np.int64).reshape(-1, 2)
    many = np.cumsum(by_count[:, 1])
    distinct = int(many[-1]) if len(many) else 0
    twigs = max(4, round(TWIGS * distinct**0.5 / BRANCHES))
    single = twigs // 2
    level = int((many <= KNOWN).sum())
    least = int(by_count[level - 1, 0]) if level else 1 << 62
    table = counts.where(F.col("n") >= least).toArrow().sort_by("word")
    known, ending, n = (table[c].to_numpy() for c in ("word", "ending", "n"))
    twig, branch = _shared_twig(ending, single, twigs), _branch(ending)
    order = np.lexsort((known, -n, branch))
    place = np.arange(len(order)) - np.searchsorted(branch[order], branch[order])
    alone = order[place < single]
    twig[alone] = branch[alone] * twigs + place[place < single]
    sums = np.bincount(twig, n + 0.5, twigs * BRANCHES) + 0.5

    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = _shared_twig(batch.column(0).to_numpy(zero_copy_only=False), single, twigs)
            yield pa.RecordBatch.from_arrays([pa.array(found), batch.column(1)], names=["twig", "n"])

    if len(known) < distinct:
        rest = counts.where(F.col("n") < least).select("ending", F.col("n").cast("double") + 0.5).toDF("ending", "n")
        for r in rest.mapInArrow(shared, "twig long, n double").groupBy("twig").agg(F.sum("n").alias("n")).collect():
            sums[r.twig] += r.n
    total = int(by_count.prod(axis=1).sum())
    return Vocabulary(known, twig, n, twigs, single, sums, total, counts.select("word", "n") if len(known) < distinct else None)


def numbered(docs: DataFrame, known: Vocabulary) -> DataFrame:
    """A table with a row for each row: number, doc_id, a hash of doc_id and text, the text's bytes, its words' twigs, how many
    those are, the summed logarithms of the words' shares of their twigs, how many were counted once only, and the words whose
    counts aren't known here, which are in neither. Texts are read and their words found once for all rounds and the scores."""
    sent, whole = docs.sparkSession.sparkContext.broadcast(known.sent()), known.counts is None

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        kind, row, log_sums = known.kind, TaskContext.get().partitionId() << 40, np.log(known.sums)
        for batch in batches:
            for t in texts(batch.column(2)):
                word, ending, first = word_numbers(t)
                twig, n = known.of(word, ending)
                n = np.maximum(n, 0) if whole else n
                other = n < 0
                share = np.where(other, 0.0, np.log(np.maximum(n, 0) + 0.5)) - log_sums[twig]
                share, once = (np.diff(np.concatenate([[0.0], np.cumsum(x)])[first]) for x in (share, n == 1))
                ends = np.concatenate([[0], np.cumsum(other)])[first].astype(np.int32)
                offsets = (first * kind.itemsize).astype(np.int32)
                columns = [
                    pa.array(np.arange(row, row + len(t))),
                    *(batch.column(c).slice(t.first, len(t)) for c in (0, 1)),
                    pa.array(np.diff(t.off)),
                    pa.Array.from_buffers(pa.binary(), len(t), [None, pa.py_buffer(offsets), pa.py_buffer(twig.astype(kind))]),
                    *(pa.array(x) for x in (np.diff(first), share, once.astype(np.int64))),
                    pa.ListArray.from_arrays(pa.array(ends), pa.array(word[other])),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["row", "doc_id", "place", "size", "twigs", "n_tokens", "share", "once", "rest"])
                row += len(t)

    rows = docs.select(F.col("doc_id").cast("long"), F.xxhash64("doc_id", "text"), "text").toDF("doc_id", "place", "text")
    return staged(rows.mapInArrow(number, NUMBERED), "numbered")


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Texts | None]]:
    """Of rows (learner, text) or (learner, what is had of a text, the text's bytes) that are sorted: each learner's in slices
    that depend on nothing but those texts, and after the last one (learner, None)."""
    learner, waiting, size = -1, [], 0
    for batch in batches:
        own, lengths = batch.column(0).to_numpy(), batch.column(2) if batch.num_columns > 2 else pc.binary_length(batch.column(1))
        lengths = lengths.to_numpy(zero_copy_only=False)
        a = 0
        for i in range(batch.num_rows + 1):
            ended = i == batch.num_rows or own[i] != learner
            if i and (ended or size >= SLICE_BYTES) and i > a:
                waiting.append(batch.column(1).slice(a, i - a))
                a = i
            if waiting and (size >= SLICE_BYTES or (ended and i < batch.num_rows)):
                yield learner, next(texts(pa.concat_arrays(waiting), 1 << 62))
                waiting, size = [], 0
            if i < batch.num_rows:
                if own[i] != learner:
                    if learner >= 0:
                        yield learner, None
                    learner = int(own[i])
                size += int(lengths[i])
    if waiting:
        yield learner, next(texts(pa.concat_arrays(waiting), 1 << 62))
    if learner >= 0:
        yield learner, None


def train(docs: DataFrame, known: Vocabulary, rounds: int = ROUNDS, learner_words: int = LEARNER_WORDS) -> Network:
    """Learners of about `learner_words` words each learn from every word of their documents in one of the rounds; after
    each round their weights are averaged, by how many words each learned from. Which documents a learner has, and in which order,
    is told by a hash of doc_id and text: how rows are dealt to tasks changes nothing, and more documents are more learners, not
    smaller ones."""
    return _learned(numbered(docs, known), known, rounds, learner_words)


def _learned(rows: DataFrame, known: Vocabulary, rounds: int = ROUNDS, learner_words: int = LEARNER_WORDS) -> Network:
    """`train` on `numbered` rows."""
    spark, net = rows.sparkSession, Network.of(known)
    twigs, kind = known.twigs, known.kind
    learners = max(1, round(known.total / learner_words))
    dealt = rows.where(F.col("size") > 0).select(F.pmod("place", F.lit(learners)).cast("long").alias("learner"), "place", "twigs", "size")
    dealt = dealt.repartitionByRange(learners, "learner").sortWithinPartitions("learner", "place", "twigs", "size").select("learner", "twigs", "size")
    size = min(BATCH, max(32, known.total // STEPS))
    rate = RATE * max(1.0, (size / 2048) ** 0.5)
    for k in range(rounds):
        start = spark.sparkContext.broadcast(net.flat)

        def learn(batches: Iterator[pa.RecordBatch], start=start, k=k) -> Iterator[pa.RecordBatch]:
            own, seen = None, 0
            for learner, t in _slices(batches):
                if t is None:
                    yield pieces(own.flat, seen, learner)
                    own, seen = None, 0
                    continue
                own = own or Network(start.value.copy(), twigs)
                twig, first = t.buf.view(kind).astype(np.int64), t.off // kind.itemsize
                wide, place = own.spread(twig, first)
                at = learned_places(first, k, rounds)
                at = at[np.random.default_rng(len(at)).permutation(len(at))]
                for a in range(0, len(at), size):
                    some = at[a : a + size]
                    own.learn(own.around(wide, place[some]), twig[some], rate)
                seen += len(at)

        flat = gathered(dealt.mapInArrow(learn, BLOB), np.float32, mean=True)
        net = Network(flat, twigs) if len(flat) == len(net.flat) else net
    return net


def learned_places(first: np.ndarray, k: int, rounds: int) -> np.ndarray:
    """The words that round k learns from; over all rounds each word once."""
    place = np.arange(first[-1]) - np.repeat(first[:-1], np.diff(first))
    return np.flatnonzero(place % rounds == k)


def score(docs: DataFrame, known: Vocabulary, net: Network) -> DataFrame:
    """(doc_id, n_tokens, log_likelihood, mean_log_prob, n_once): the summed and mean log-probability of every word of
    a text, given the words on both sides, and how many of its words were counted once only. Without words (or null)
    all are 0. A row for each row; repeated and null doc_ids come out as they are, other columns are not looked at.
    Words that were not counted are taken as one word with half an occurrence in each twig."""
    return _judged(numbered(docs, known), known, net)


def _judged(numbers: DataFrame, known: Vocabulary, net: Network) -> DataFrame:
    """`score` of `numbered` rows."""
    weights, twigs, kind = numbers.sparkSession.sparkContext.broadcast(net.flat), known.twigs, known.kind

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Network(weights.value, twigs)
        for batch in batches:
            for t in texts(batch.column(0), 1 << 17):
                twig, first = t.buf.view(kind).astype(np.int64), t.off // kind.itemsize
                wide, place = own.spread(twig, first)
                each = np.zeros(len(twig))
                for a in range(0, len(twig), 4096):
                    each[a : a + 4096] = own.log_probs(own.around(wide, place[a : a + 4096]), twig[a : a + 4096])
                row, doc_id, count, share, once = (batch.column(c).slice(t.first, len(t)) for c in range(1, 6))
                part = np.diff(np.concatenate([[0.0], np.cumsum(each)])[first]) + share.to_numpy()
                yield pa.RecordBatch.from_arrays([row, doc_id, count, pa.array(part), once], names=["row", "doc_id", "n_tokens", "part", "once"])

    rows = numbers.select("twigs", "row", "doc_id", "n_tokens", "share", "once").mapInArrow(judge, JUDGED)
    total, once = F.col("part"), F.col("once")
    if known.counts is not None:
        rest = numbers.select("row", F.explode("rest").alias("word")).join(known.counts.hint("shuffle_merge"), "word", "left")
        n: Column = F.coalesce("n", F.lit(0))
        more = rest.groupBy("row").agg(F.sum(F.log(n + 0.5)).alias("more"), F.count_if(n == 1).alias("more_once"))
        rows = rows.join(more, "row", "left")
        total, once = total + F.coalesce("more", F.lit(0.0)), once + F.coalesce("more_once", F.lit(0))
    return rows.select("doc_id", "n_tokens", total.alias("log_likelihood"), (total / F.greatest("n_tokens", F.lit(1))).alias("mean_log_prob"), once.alias("n_once"))


def scored(docs: DataFrame) -> DataFrame:
    """Learns from all of `docs` and scores all of them."""
    known = vocabulary(docs)
    rows = numbered(docs, known)
    return _judged(rows, known, _learned(rows, known))
