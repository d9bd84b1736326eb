"""Arrow batches of texts as UTF-8 byte arrays, and the word hashes that several operators share."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
#: Bytes of text that one round of array work takes; a longer text goes alone.
SLICE_BYTES = 1 << 20


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64-bit words (xor-shift and multiply)."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


@dataclass
class Texts:
    """Consecutive texts of a batch: `buf` holds their bytes, text i is buf[off[i]:off[i + 1]]."""

    first: int
    buf: np.ndarray
    off: np.ndarray

    def __len__(self) -> int:
        return len(self.off) - 1


def texts(column: pa.Array, most: int = SLICE_BYTES) -> Iterator[Texts]:
    """Splits a string column (null: empty) into runs of about `most` bytes."""
    column = pc.fill_null(column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column, "")
    if not len(column):
        return
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    buf = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    a = 0
    while a < len(column):
        b = max(a + 1, int(np.searchsorted(off, off[a] + most, "right")) - 1)
        yield Texts(a, buf[off[a] : off[b]], off[a : b + 1] - off[a])
        a = b


_P = 0x9E3779B97F4A7C15 | 1
_PI = pow(_P, -1, 1 << 64)
_powers: tuple[np.ndarray, np.ndarray] = (np.ones(1, U), np.ones(1, U))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of an odd constant modulo 2^64 and of its inverse."""
    global _powers
    if len(_powers[0]) < n:
        n = max(n, SLICE_BYTES + 1)
        both = []
        for p in (_P, _PI):
            x = np.full(n, p, U)
            x[0] = 1
            both.append(np.multiply.accumulate(x))
        _powers = tuple(both)
    return _powers


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: A word is a run of bytes other than space and 0x09 to 0x0D.
SPACES = np.zeros(256, bool)
SPACES[[32, *range(9, 14)]] = True
#: For looser matching, ASCII punctuation and control characters also separate words.
PUNCTUATION = np.ones(256, bool)
PUNCTUATION[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False


@dataclass
class Words:
    """Words of `Texts`, lower-cased A-Z: byte ranges, 64-bit hashes; text i has words first[i] to first[i + 1]."""

    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray


def words(t: Texts, breaks: np.ndarray = SPACES, cut: np.ndarray | None = None) -> Words:
    """cut: positions at which a word ends and another begins."""
    n = len(t.buf)
    if not n:
        none = np.zeros(0, np.int64)
        return Words(none, none, np.zeros(0, U), np.zeros(len(t) + 1, np.int64))
    inside = ~breaks[t.buf]
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = inside[:-1]
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = inside[1:]
    edge = t.off[1:-1]
    before[edge[edge < n]] = False
    after[edge[edge > 0] - 1] = False
    if cut is not None:
        before[cut] = False
        after[cut - 1] = False
    start = np.flatnonzero(inside & ~before)
    end = np.flatnonzero(inside & ~after) + 1
    power, inverse = powers(n + 1)
    sums = np.zeros(n + 1, U)
    np.cumsum((LOWER[t.buf].astype(U) + U(1)) * power[:n], out=sums[1:])
    value = (sums[end] - sums[start]) * inverse[start]
    return Words(start, end, mix64(value ^ ((end - start).astype(U) << U(48))), np.searchsorted(start, t.off))


_Q = [pow(0xD6E8FEB86659FD93, k, 1 << 64) for k in range(64)]


def shingles(w: Words, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each run of `size` words, and where each text's begin (one more entry than texts).
    A text with fewer words has its whole sequence as one; without words, none."""
    n = len(w.hash)
    count = np.diff(w.first)
    out = np.zeros(n, U)
    if n >= size:
        total = np.zeros(n - size + 1, U)
        for k in range(size):
            total += w.hash[k : n - size + 1 + k] * U(_Q[k])
        out[: n - size + 1] = mix64(total + U(size))
    keep = np.ones(n, bool)
    text = np.repeat(np.arange(len(count)), count)
    place = np.arange(n) - w.first[text]
    keep[place > np.maximum(count - size, 0)[text]] = False
    for i in np.flatnonzero((count > 0) & (count < size)):
        h = w.hash[w.first[i] : w.first[i + 1]]
        out[w.first[i]] = mix64(np.sum(h * np.array(_Q[: len(h)], U), keepdims=True) + U(len(h)))[0]
    lengths = np.where(count > 0, np.maximum(count - size + 1, 1), 0)
    return out[keep], np.concatenate([[0], np.cumsum(lengths)])
