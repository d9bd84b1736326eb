"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams, trained by
follow-the-regularised-leader with elastic-net penalties and calibrated by a temperature."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldloom.llm.batches import Texts, texts
from fieldloom.llm.staging import staged
from fieldloom.llm.sums import BLOB, gathered, pieces

#: Hashed n-gram features (2^BITS) of one to three characters.
BITS, ORDERS = 15, 3
#: Labelled documents that the classifier is fitted on: at most so many of each language, those with the
#: smallest hash of doc_id and text, and about so many in all. Their n-gram counts go to the driver, which fits the model.
SAMPLE_PER_LANG, SAMPLE_ROWS = 600, 60_000
#: At most so many languages are learned; the model has 2^BITS weights for each.
MOST_LANGS = 512
#: One in so many of those is for the temperature only.
CALIBRATION = 5
UNKNOWN = "und"
PREDICTED = "doc_id long, lang_pred string, score double"
#: Bytes of text whose n-grams are taken at once; a longer text is taken in parts.
CHARS = 1 << 18
#: A text is of no learned language if its n-grams are less likely in the best one by so many deviations. They count
#: n-grams as independent, which those of one text aren't, and texts may mix languages, so it is far out.
DEVIATIONS = 20.0
#: Scales mean n-gram weights, so that rows have about unit length and learning isn't slow.
SCALE = 8.0


def held_out() -> Column:
    """crc32 of doc_id as text, modulo 3, is 1: never learned from."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """By code point: its lower-case form if it is a letter, else 0."""
    out = np.zeros(0x110000, np.uint32)
    for c in range(0x110000):
        x = chr(c)
        if x.isalpha():
            low = x.lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


def _letters(t: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points, the text of each, and which texts have a letter. Letters are lower-cased, everything else is one
    space (0); runs of spaces count once."""
    lead = (t.buf & 0xC0) != 0x80
    starts = np.concatenate([[0], np.cumsum(lead)])[t.off]
    raw = np.frombuffer(t.buf.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    c = _classes()[np.minimum(raw, 0x10FFFF)]
    text = np.repeat(np.arange(len(t)), np.diff(starts))
    keep = np.ones(len(c), bool)
    keep[1:] = (c[1:] != 0) | (c[:-1] != 0) | (text[1:] != text[:-1])
    has = np.zeros(len(t), bool)
    has[np.unique(text[c != 0])] = True
    return c[keep], text[keep], has


def _hashed(c: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Feature numbers at each position and order; beyond a text's end are spaces."""
    f = np.zeros((len(c), ORDERS), np.int64)
    h = np.zeros(len(c), np.uint32)
    for n in range(ORDERS):
        shifted = np.zeros(len(c), np.uint32)
        if n < len(c):
            shifted[: len(c) - n] = c[n:]
            same = np.zeros(len(c), bool)
            same[: len(c) - n] = text[n:] == text[: len(c) - n]
            shifted[~same] = 0
        h = (h + shifted + np.uint32(n + 1)) * np.uint32(0x9E3779B1)
        h ^= h >> np.uint32(15)
        f[:, n] = (h * np.uint32(0x85EBCA77)) >> np.uint32(32 - BITS)
    return f


def features(t: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Feature numbers at each position and order, where each text's characters begin, and which texts have a
    letter."""
    c, text, has = _letters(t)
    return _hashed(c, text), np.searchsorted(text, np.arange(len(t) + 1)), has


def _is_long(t: Texts) -> bool:
    return len(t) == 1 and len(t.buf) > 2 * CHARS


def _long_counts(t: Texts) -> tuple[np.ndarray, int, bool]:
    """How often each feature occurs in one long text, its characters, and whether it has a letter. It is taken in
    parts; a part begins with the last characters of the one before, so the n-grams across cuts are counted too."""
    total, n, letters = np.zeros(1 << BITS, np.int64), 0, False
    carry, a = np.zeros(0, np.uint32), 0
    while a < len(t.buf):
        b = min(a + CHARS, len(t.buf))
        while b < len(t.buf) and t.buf[b] & 0xC0 == 0x80:
            b += 1
        c, _, has = _letters(Texts(t.first, t.buf[a:b], np.array([0, b - a])))
        if len(carry) and len(c) and carry[-1] == 0 == c[0]:
            c = c[1:]
        x = np.concatenate([carry, c])
        end = np.arange(len(x))[:, None] + np.arange(ORDERS)
        new = (end >= len(carry)) & ((b == len(t.buf)) | (end < len(x)))
        total += np.bincount(_hashed(x, np.zeros(len(x), np.int64))[new], minlength=1 << BITS)
        n, letters = n + len(c), letters | bool(has[0])
        carry, a = x[max(0, len(x) - ORDERS + 1) :], b
    return total, n, letters


def _counted(t: Texts) -> Iterator[tuple[int, np.ndarray]]:
    """Number of a text with a letter, and how often each feature occurs in it."""
    if _is_long(t):
        total, _, letters = _long_counts(t)
        if letters:
            yield 0, total
        return
    f, first, has = features(t)
    for i in np.flatnonzero(has).tolist():
        yield i, np.bincount(f[first[i] : first[i + 1]].ravel(), minlength=1 << BITS)


def _document_counts(docs: DataFrame) -> np.ndarray:
    """In how many documents each feature occurs, over all rows of `docs`; the last entry counts the documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((1 << BITS) + 1, np.int64)
        for batch in batches:
            for t in texts(batch.column(0), CHARS):
                for _, n in _counted(t):
                    total[np.flatnonzero(n)] += 1
                    total[-1] += 1
        yield pieces(total, 1.0)

    found = gathered(docs.select("text").mapInArrow(count, BLOB), np.int64, mean=False)
    return found if len(found) else np.zeros((1 << BITS) + 1, np.int64)


@dataclass
class Model:
    """score of a text: mean over its n-grams of table[feature], plus bias, divided by the temperature.

    log_p: of each feature in each language; mean, spread and noise: of the mean of log_p over the n-grams of a text
    of the language, over texts, and what one n-gram adds to it."""

    langs: list[str]
    table: np.ndarray
    bias: np.ndarray
    temperature: float
    log_p: np.ndarray
    mean: np.ndarray
    spread: np.ndarray
    noise: np.ndarray

    def predict(self, t: Texts, judged: bool = False) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Names, scores and, if `judged`, by how many deviations each text is more likely in its language than a text
        of it is on average. Of languages with equal probabilities the first by name is taken."""
        sums, n, known = np.zeros((len(t), len(self.langs))), np.zeros(len(t), np.int64), np.zeros(len(t), bool)
        likely = np.zeros((len(t), len(self.langs)))
        tables = [(self.table, sums), *([(self.log_p, likely)] if judged else [])]
        if _is_long(t):
            total, n[0], known[0] = _long_counts(t)
            for table, to in tables:
                to[0] = total.astype(np.float64) @ table
        else:
            f, first, known = features(t)
            n = np.diff(first)
            full = np.flatnonzero(n)
            for table, to in tables if len(full) else []:
                each = table[f[:, 0]]
                for k in range(1, ORDERS):
                    each += table[f[:, k]]
                to[full] += np.add.reduceat(each.astype(np.float64), first[full], axis=0)
        grams = (ORDERS * np.maximum(n, 1))[:, None]
        p = _softmax((sums / grams + self.bias) / self.temperature)
        best = p.argmax(axis=1) if self.langs else np.zeros(len(t), int)
        known &= bool(self.langs)
        names = [self.langs[b] if k else UNKNOWN for b, k in zip(best, known, strict=True)]
        each = np.arange(len(t))
        score = np.where(known, np.clip(p[each, best], 0, 1) if self.langs else 0.0, 0.0)
        if not (judged and self.langs):
            return names, score, np.zeros(len(t))
        off = (likely / grams)[each, best] - self.mean[best]
        return names, score, off / np.sqrt(self.spread[best] + self.noise[best] / grams[:, 0])


def _typical(rows: list[tuple[np.ndarray, np.ndarray, int]], labels: np.ndarray, fit: np.ndarray, classes: int) -> tuple[np.ndarray, ...]:
    """log_p, mean, spread and noise of `Model`, from rows (feature, share of the text's n-grams, number of those):
    log_p from the rows `fit`, the others from the rest (where there are few, from all)."""
    log_p, numbers = np.zeros((1 << BITS, classes), np.float32), np.zeros((3, classes))
    for k in range(classes):
        mine = np.flatnonzero(labels == k)
        total = np.ones(1 << BITS)
        for i in mine[fit[mine]]:
            at, share, n = rows[i]
            total[at] += share * n
        log_p[:, k] = np.log(total / total.sum())
        rest = mine[~fit[mine]]
        found = [((x := log_p[at, k]) @ share, (x * x) @ share, n) for at, share, n in (rows[i] for i in (rest if len(rest) >= 10 else mine))]
        m, squares, n = (np.array(x, float) for x in zip(*found, strict=True))
        noise = np.maximum(squares - m * m, 0)
        numbers[:, k] = np.average(m, weights=n), max((np.average((m - np.average(m, weights=n)) ** 2, weights=n)), 1e-3), noise.mean() + 1e-3
    return log_p, *numbers


def _softmax(x: np.ndarray) -> np.ndarray:
    if not x.shape[1]:
        return x
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def ftrl(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, classes: int, alpha: float = 0.5, beta: float = 1.0, l1: float = 2e-4, l2: float = 1e-4, epochs: int = 5, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Weights (features + 1, classes), the last row the bias, by FTRL-proximal over sparse rows (index, value)."""
    size = (1 << BITS) + 1
    z, n = np.zeros((size, classes)), np.zeros((size, classes))
    order = np.random.default_rng(seed)

    def weights(at: np.ndarray | slice) -> np.ndarray:
        zi = z[at]
        w = -(zi - np.sign(zi) * l1) / ((beta + np.sqrt(n[at])) / alpha + l2)
        return np.where(np.abs(zi) <= l1, 0.0, w)

    for _ in range(epochs):
        for i in order.permutation(len(rows)):
            at, x = rows[i]
            w = weights(at)
            g = _softmax((x @ w)[None])[0]
            g[labels[i]] -= 1
            g = x[:, None] * g
            step = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha
            z[at] += g - step * w
            n[at] += g * g
    w = weights(slice(None))
    return w[:-1], w[-1]


def train(docs: DataFrame, per_lang: int = SAMPLE_PER_LANG) -> Model:
    """Learns from text and non-null lang of the rows of `docs` that aren't held out.

    Document frequencies count every such row. The classifier and its temperature are fitted on a bounded sample, at
    most `per_lang` different rows of each language, those with the smallest hash of doc_id and text; a null doc_id is one
    like others, and rows that are repeated are learned from once. Of more than MOST_LANGS languages those with the most
    rows are learned.
    """
    learn = docs.where(~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text", F.xxhash64("doc_id", "text").alias("place"))
    counts = _document_counts(learn)
    idf = np.log((1 + counts[-1]) / (1 + counts[:-1])) + 1
    # of a language with many rows only those with small hashes come to its sort, whichever are repeated
    sizes = learn.groupBy("lang").agg(F.count(F.lit(1)).alias("rows"), F.approx_count_distinct("place", 0.02).alias("n"))
    sizes = staged(sizes.orderBy(F.desc("rows"), "lang").limit(MOST_LANGS).select("lang", "n"), "langs")
    per_lang = max(1, min(per_lang, SAMPLE_ROWS // max(1, sizes.count())))
    near = learn.join(F.broadcast(sizes), "lang").where((F.col("place") / F.lit(2.0**64) + 0.5) * F.col("n") < 2 * per_lang + 20)
    near = near.groupBy("lang", "place").agg(F.min("text").alias("text"))
    chosen = near.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy("place"))).where(F.col("k") <= per_lang)

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in texts(batch.column("text"), CHARS):
                out: list[list] = [[], [], [], [], []]
                for i, n in _counted(t):
                    own = np.flatnonzero(n)
                    row = (batch.column("place")[t.first + i].as_py(), batch.column("lang")[t.first + i].as_py(), own.astype("<i4").tobytes(), (n[own] / n.sum()).astype("<f4").tobytes(), int(n.sum()))
                    for to, value in zip(out, row, strict=True):
                        to.append(value)
                kinds = [pa.int64(), pa.string(), pa.binary(), pa.binary(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(o, k) for o, k in zip(out, kinds, strict=True)], names=["place", "lang", "at", "tf", "n"])

    rows = chosen.select("place", "lang", "text").mapInArrow(extract, "place long, lang string, at binary, tf binary, n long").collect()
    rows.sort(key=lambda r: (r.place, r.lang))
    langs = sorted({r.lang for r in rows})
    none = np.zeros(0)
    if not langs:
        return Model([], np.zeros((1 << BITS, 0), np.float32), none, 1.0, np.zeros((1 << BITS, 0), np.float32), none, none, none)
    labels = np.array([langs.index(r.lang) for r in rows])
    shares = [(np.frombuffer(r.at, "<i4"), np.frombuffer(r.tf, "<f4"), r.n) for r in rows]
    sparse = [(np.append(at, 1 << BITS), np.append(tf * idf[at] * SCALE, 1.0)) for at, tf, _ in shares]
    check = np.arange(len(rows)) % CALIBRATION == CALIBRATION - 1
    keep = np.flatnonzero(~check)
    w, bias = ftrl([sparse[i] for i in keep], labels[keep], len(langs))
    temperature = 1.0
    if check.any():
        full = np.vstack([w, bias])
        logits = np.array([x @ full[at] for at, x in (sparse[i] for i in np.flatnonzero(check))])
        own = labels[check]
        loss = lambda s: -np.log(np.maximum(_softmax(logits / s)[np.arange(len(own)), own], 1e-12)).mean()
        temperature = float(min(np.geomspace(0.05, 20, 121), key=loss))
    return Model(langs, (w * idf[:, None] * SCALE).astype(np.float32), bias, temperature, *_typical(shares, labels, ~check, len(langs)))


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, lang_pred, score) of every row's whole text; only the text is looked at. A null text, or one
    without a letter, is `und` with score 0, as is every text if nothing was learned; of languages with equal
    probabilities the first by name is taken. Repeated and null doc_ids come out as they are."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in texts(batch.column(1), CHARS):
                names, score, _ = sent.value.predict(t)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(t.first, len(t)), pa.array(names, pa.string()), pa.array(score)], names=["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(predict, PREDICTED)


def predicted(docs: DataFrame) -> DataFrame:
    """Trains on `docs` and predicts all of them, with whether each was held out."""
    return identify(docs, train(docs)).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def with_known_language(docs: DataFrame, deviations: float = DEVIATIONS) -> DataFrame:
    """The documents, all columns, of a learned language: with a letter, and with n-grams that are not less likely in the
    predicted language than those of its texts are, by more than so many deviations of texts of their length. How
    many languages were learned plays no part. If nothing was learned, all go. Repeated rows and null doc_ids are
    treated like others."""
    sent = docs.sparkSession.sparkContext.broadcast(train(docs))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good: list[bool] = []
            for t in texts(batch.column("text"), CHARS):
                names, _, off = sent.value.predict(t, judged=True)
                good += [n != UNKNOWN and o >= -deviations for n, o in zip(names, off, strict=True)]
            yield batch.filter(pa.array(good, pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)
