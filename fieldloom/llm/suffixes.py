"""Removal of repeated byte strings by a depth-limited, most-significant-digit sort of sampled suffixes.

Only suffixes at *anchors* are sorted. A window of WINDOW bytes chooses the smallest hash among the grams of
GRAM bytes in it (the leftmost, on a tie), so equal windows choose the same place and every window holds an
anchor. The sort never looks further than a window reaches around its anchor:

1. first digit: the anchor's gram. Suffixes alone with their gram drop out.
2. second digit: the whole context, all windows around the anchor at once. Where a smaller document has the same
   context, all of it goes.
3. Where one gram has several contexts, the windows at each distance from the anchor are sorted by eight bytes at
   a time; groups that are left after WINDOW bytes are exactly the repeated windows.

Groups are never expanded into pairs: each keeps its smallest document only. Suffixes travel as packed arrays,
texts as compressed blocks of documents.

A gram may stand in very many documents. What a task sends is combined first: of equal contexts only the smallest
document's goes on, as the others are covered by it. A gram that has many contexts nonetheless, as at the ends of
a common passage, is hot: its windows are dealt out by their own hashes, and of equal ones in a block of documents
again only the smallest document's goes on.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.llm.batches import Texts, U, mix64, powers, texts
from fieldloom.llm.staging import staged

WINDOW, GRAM = 50, 20
#: How far windows with one anchor reach before and behind its first byte.
BEFORE, BEHIND = WINDOW - GRAM, WINDOW
SPAN = BEFORE + BEHIND
#: Bytes of text for each block of documents, and for each bucket of grams.
BLOCK_BYTES, BUCKET_BYTES = 12 << 20, 32 << 20
#: Bytes of text whose suffixes a task gathers before it sends them.
SEND_BYTES = 12 << 20
#: A gram is hot with more contexts than the first in what a task sends at once, or the second in its bucket.
HOT_SENT, HOT_OPEN = 64, 1 << 16
#: Hot anchors whose windows are hashed at a time.
HASH_ROWS = 1 << 14
COVERED, OPEN, HOT = 1, 2, 3
#: Set in the place of a suffix that stands for its hot gram.
MARK = 1 << 31
TEXT, SUFFIX, FLAGS, SPANS, CONTEXT, WINDOWS = range(6)
PACKED = "key long, kind int, tag long, ids binary, sizes binary, data binary"
RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _packed(rows: Iterable[tuple[int, int, int, np.ndarray, np.ndarray, bytes]]) -> pa.RecordBatch:
    cols = list(zip(*((k, kind, tag, ids.tobytes(), sizes.tobytes(), data) for k, kind, tag, ids, sizes, data in rows), strict=True)) or [[]] * 6
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["key", "kind", "tag", "ids", "sizes", "data"])


def _rows(table: pa.Table, kind: int) -> Iterator[tuple[int, bytes, bytes, bytes]]:
    for batch in table.to_batches():
        columns = [batch.column(i) for i in range(6)]
        for i in range(batch.num_rows):
            if columns[1][i].as_py() == kind:
                yield columns[2][i].as_py(), *(c[i].as_py() for c in columns[3:])


def anchors(t: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text number, first byte and gram hash of each anchor, in order, and the first and the last of the windows
    that choose it."""
    n = len(t.buf)
    none = np.zeros(0, np.int64)
    if n < WINDOW:
        return none, none, np.zeros(0, U), none, none
    power, inverse = powers(n + 1)
    sums = np.zeros(n + 1, U)
    np.cumsum((t.buf.astype(U) + U(1)) * power[:n], out=sums[1:])
    gram = mix64((sums[GRAM:] - sums[:-GRAM]) * inverse[: n - GRAM + 1])
    low = (gram & U(0xFFFFFFFF00000000)) | np.arange(len(gram), dtype=U)
    width, want = 1, WINDOW - GRAM + 1
    while 2 * width <= want:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    low = np.minimum(low[: len(low) - (want - width)], low[want - width :]) if want > width else low
    text = np.repeat(np.arange(len(t)), np.diff(t.off))
    starts = np.flatnonzero(text[: n - WINDOW + 1] == text[WINDOW - 1 :])
    at = (low[starts] & U(0xFFFFFFFF)).astype(np.int64)
    keep = np.ones(len(at), bool)
    keep[1:] = at[1:] != at[:-1]
    new = np.flatnonzero(keep)
    at = at[new]
    return text[at], at, gram[at], starts[new], starts[np.append(new[1:], len(starts)) - 1] if len(new) else none


def contexts(t: Texts, text: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and end byte of each anchor's context, cut at its text's ends, and a hash of bytes and cut."""
    first, end = np.maximum(at - BEFORE, t.off[text]), np.minimum(at + BEHIND, t.off[text + 1])
    power, inverse = powers(len(t.buf) + 1)
    sums = np.zeros(len(t.buf) + 1, U)
    np.cumsum((t.buf.astype(U) + U(1)) * power[: len(t.buf)], out=sums[1:])
    cut = ((at - first) * 256 + end - at).astype(U)
    return first, end, mix64((sums[end] - sums[first]) * inverse[first] + mix64(cut))


def _bucket(gram: np.ndarray, buckets: int) -> np.ndarray:
    return ((gram & U(0xFFFFFFFF)) % U(buckets)).astype(np.int64)


def _block(row: np.ndarray, blocks: int) -> np.ndarray:
    return (mix64(row.view(U)) % U(blocks)).astype(np.int64)


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    return np.repeat(starts - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())


def _first_digits(doc: np.ndarray, gram: np.ndarray, context: np.ndarray, most: int, marked: np.ndarray | None = None) -> np.ndarray:
    """Flags of suffixes by their grams and contexts; of a gram with more than `most` contexts, or a marked suffix,
    those that aren't covered are hot."""
    flags = np.zeros(len(gram), np.uint8)
    order = np.argsort(gram, kind="stable")
    same = gram[order][1:] == gram[order][:-1]
    order = order[np.append(same, False) | np.insert(same, 0, False)] if len(order) else order
    order = order[np.lexsort((doc[order], context[order], gram[order]))]
    if not len(order):
        return flags
    own = doc[order]
    new_gram = np.concatenate([[True], gram[order][1:] != gram[order][:-1]])
    new_context = new_gram | np.concatenate([[True], context[order][1:] != context[order][:-1]])
    of_gram, of_context = np.cumsum(new_gram) - 1, np.cumsum(new_context) - 1
    least = own[new_context][of_context]
    many = np.bincount(of_gram, new_context)
    at = np.flatnonzero(new_gram)
    mixed = np.minimum.reduceat(own, at) < np.maximum.reduceat(own, at)
    hot = mixed & (many > most)
    if marked is not None:
        hot |= np.bincount(of_gram, marked[order]) > 0
    flags[order] = np.where(own > least, COVERED, np.where(hot, HOT, np.where(mixed & (many > 1), OPEN, 0))[of_gram])
    return flags


def _flag_rows(row: np.ndarray, place: np.ndarray, flags: np.ndarray, blocks: int) -> list[tuple]:
    """Packed flags by block; place: the anchor's number in its document."""
    block = _block(row, blocks)
    order = np.lexsort((row, block))
    block, row, place, flags = block[order], row[order], place[order], flags[order]
    edge, out = np.append(np.flatnonzero(np.diff(block, prepend=-1)), len(block)), []
    for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
        new = np.flatnonzero(np.concatenate([[True], row[a + 1 : b] != row[a : b - 1]]))
        out.append((int(block[a]), FLAGS, b - a, row[a:b][new], np.diff(np.append(new, b - a)).astype(np.uint32), place[a:b].astype(np.uint32).tobytes() + flags[a:b].tobytes()))
    return out


def _send_suffixes(parts: int, blocks: int, most: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Suffixes by bucket. Spans and flags that are known already go along, with their block as tag."""

    def pack(held: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        row, doc, gram, context, place, first, end = (np.concatenate(x) for x in zip(*held, strict=True))
        flags = _first_digits(doc, gram, context, most)
        gone, hot = flags == COVERED, np.flatnonzero(flags == HOT)
        known = _spans(row[gone], first[gone], end[gone], blocks) + _flag_rows(row[hot], place[hot], flags[hot], blocks)
        rows = [(to % parts, kind, to, ids, sizes, np.int64(tag).tobytes() + data) for to, kind, tag, ids, sizes, data in known]
        sent = ~gone & (flags != HOT)
        marks = hot[np.unique(gram[hot], return_index=True)[1]]
        sent[marks] = True
        place = place.astype(np.uint32)
        place[marks] |= np.uint32(MARK)
        row, doc, gram, context, place = (x[sent] for x in (row, doc, gram, context, place))
        bucket = _bucket(gram, parts)
        order = np.argsort(bucket, kind="stable")
        edge = np.searchsorted(bucket[order], np.arange(parts + 1))
        for b in np.flatnonzero(np.diff(edge)).tolist():
            mine = order[edge[b] : edge[b + 1]]
            new = np.flatnonzero(np.concatenate([[True], (row[mine][1:] != row[mine][:-1]) | (doc[mine][1:] != doc[mine][:-1])]))
            sizes = np.diff(np.append(new, len(mine))).astype(np.uint32)
            data = (gram[mine] >> U(32)).astype(np.uint32).tobytes() + place[mine].tobytes() + context[mine].tobytes()
            rows.append((b, SUFFIX, len(mine), np.stack([row[mine][new], doc[mine][new]]), sizes, data))
        return _packed(rows)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        size = 0
        for batch in batches:
            doc, row = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for t in texts(batch.column(2)):
                text, at, gram, _, _ = anchors(t)
                first, end, context = contexts(t, text, at)
                place, base = np.arange(len(text)) - np.searchsorted(text, text), t.off[text]
                held.append((row[t.first + text], doc[t.first + text], gram, context, place, first - base, end - base))
                if (size := size + len(t.buf)) >= SEND_BYTES:
                    yield pack(held)
                    held, size = [], 0
        if held:
            yield pack(held)

    return send


def _send_texts(blocks: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def pack(held: list[tuple[np.ndarray, np.ndarray, list[bytes]]]) -> pa.RecordBatch:
        row, doc = (np.concatenate([h[i] for h in held]) for i in range(2))
        text = [x for h in held for x in h[2]]
        block, squeeze, rows = _block(row, blocks), zstandard.ZstdCompressor(level=1), []
        order = np.argsort(block, kind="stable")
        edge = np.searchsorted(block[order], np.arange(blocks + 1))
        for b in np.flatnonzero(np.diff(edge)).tolist():
            mine = order[edge[b] : edge[b + 1]]
            own = [text[i] for i in mine]
            rows.append((b, TEXT, 0, np.stack([row[mine], doc[mine]]), np.array([len(x) for x in own], np.int64), squeeze.compress(b"".join(own))))
        return _packed(rows)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for a in range(0, batch.num_rows, 1000):
                part = batch.slice(a, 1000)
                own = [x or b"" for x in part.column(2).cast(pa.binary()).to_pylist()]
                held.append((part.column(1).to_numpy(), part.column(0).to_numpy(), own))
                if (size := size + sum(map(len, own))) >= SEND_BYTES:
                    yield pack(held)
                    held, size = [], 0
        if held:
            yield pack(held)

    return send


def _flag_suffixes(blocks: int, most: int) -> Callable[[pa.Table], pa.Table]:
    """First and second digit: flags for the suffixes of one bucket, sent to their documents' blocks."""

    def flag(table: pa.Table) -> pa.Table:
        rows = []
        for kind, width in ((SPANS, np.int64), (FLAGS, np.uint32)):
            for to, ids, sizes, data in _rows(table, kind):
                rows.append((to, kind, int(np.frombuffer(data, np.int64, 1)[0]), np.frombuffer(ids, np.int64), np.frombuffer(sizes, width), data[8:]))
        parts = ([], [], [], [], [], [])
        for n, ids, sizes, data in _rows(table, SUFFIX):
            row, doc = np.frombuffer(ids, np.int64).reshape(2, -1)
            of = (row, doc, np.frombuffer(sizes, np.uint32), np.frombuffer(data, np.uint32, n), np.frombuffer(data, np.uint32, n, 4 * n), np.frombuffer(data, U, n, 8 * n))
            for to, x in zip(parts, of, strict=True):
                to.append(x)
        if parts[0]:
            row, doc, sizes, gram, place, context = map(np.concatenate, parts)
            row, doc = np.repeat(row, sizes), np.repeat(doc, sizes)
            flags = _first_digits(doc, gram, context, most, place >= MARK)
            some = flags > 0
            rows += _flag_rows(row[some], place[some] & np.uint32(MARK - 1), flags[some], blocks)
        return pa.Table.from_batches([_packed(rows)])

    return flag


def _block_texts(table: pa.Table) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    row, doc, text = [], [], []
    for _, ids, sizes, data in _rows(table, TEXT):
        r, d = np.frombuffer(ids, np.int64).reshape(2, -1)
        raw, ends = zstandard.ZstdDecompressor().decompress(data), np.cumsum(np.frombuffer(sizes, np.int64))
        text += [raw[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]
        row.append(r)
        doc.append(d)
    return (np.concatenate(row), np.concatenate(doc), text) if row else (np.zeros(0, np.int64), np.zeros(0, np.int64), [])


def _spans(row: np.ndarray, first: np.ndarray, end: np.ndarray, blocks: int) -> list[tuple]:
    """Packed spans by block; of one document's, those that touch are joined."""
    order = np.lexsort((first, row))
    row, first, end = row[order], first[order], end[order]
    if len(row):
        apart = np.cumsum(np.insert(row[1:] != row[:-1], 0, False)) << 40
        reach = np.maximum.accumulate(end + apart)
        new = np.concatenate([[True], first[1:] + apart[1:] > reach[:-1]])
        at = np.flatnonzero(new)
        row, first, end = row[at], first[at], np.maximum.reduceat(end, at)
    block = _block(row, blocks)
    return [(b, SPANS, 0, row[mine], np.stack([first[mine], end[mine]]), b"") for b in np.unique(block).tolist() for mine in [np.flatnonzero(block == b)]]


def _window_hashes(raw: np.ndarray, byte: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the anchors at `byte`, each window that starts `low` to `high` bytes from the anchor: number of the
    anchor, distance of the start, hash."""
    power, inverse = powers(SPAN + 1)
    out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, U))]
    for a in range(0, len(byte), HASH_ROWS):
        near = raw[np.clip(byte[a : a + HASH_ROWS, None] + np.arange(-BEFORE, BEHIND), 0, len(raw) - 1)].astype(U) + U(1)
        sums = np.zeros((len(near), SPAN + 1), U)
        np.cumsum(near * power[:SPAN], axis=1, out=sums[:, 1:])
        for shift in range(BEFORE + 1):
            whole = np.flatnonzero((low[a : a + HASH_ROWS] <= shift - BEFORE) & (shift - BEFORE <= high[a : a + HASH_ROWS]))
            value = mix64((sums[whole, shift + WINDOW] - sums[whole, shift]) * inverse[shift])
            out.append((whole + a, np.full(len(whole), shift - BEFORE), value))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _later(value: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Whether a smaller document has the same value."""
    order = np.lexsort((doc, value))
    new = np.concatenate([[True], value[order][1:] != value[order][:-1]])[: len(order)]
    out = np.zeros(len(value), bool)
    out[order] = doc[order] > doc[order][new][np.cumsum(new) - 1] if len(order) else False
    return out


def _apply_flags(buckets: int, blocks: int) -> Callable[[pa.Table], pa.Table]:
    """Spans of the covered contexts of one block, and what needs the third digit: contexts, by gram, and windows
    of hot grams, by window."""

    def apply(table: pa.Table) -> pa.Table:
        row, doc, text = _block_texts(table)
        row, first_of = np.unique(row, return_index=True)
        doc = doc[first_of]
        rows = [(table["key"][0].as_py(), SPANS, 0, np.frombuffer(ids, np.int64), np.frombuffer(sizes, np.int64), b"") for _, ids, sizes, _ in _rows(table, SPANS)]
        whose, at, first, end, low, high, bucket, byte = [], [], [], [], [], [], [], []
        flagged = list(_rows(table, FLAGS))
        wanted = np.zeros(len(row), bool)
        for _, ids, _, _ in flagged:
            wanted[np.searchsorted(row, np.frombuffer(ids, np.int64))] = True
        some = np.flatnonzero(wanted)
        column = pa.array([text[first_of[i]] for i in some], pa.large_binary()).view(pa.large_string())
        raw, before = np.frombuffer(b"".join(text[first_of[i]] for i in some), np.uint8), 0
        for t in texts(column):
            own, p, g, a, b = anchors(t)
            c, e, _ = contexts(t, own, p)
            base = t.off[own]
            for to, x in zip((whose, at, first, end, low, high, bucket, byte), (some[t.first + own], p - base, c - base, e - base, a - p, b - p, _bucket(g, buckets), before + p), strict=True):
                to.append(x)
            before += len(t.buf)
        if not whose:
            return pa.Table.from_batches([_packed(rows)])
        whose, at, first, end, low, high, bucket, byte = map(np.concatenate, (whose, at, first, end, low, high, bucket, byte))
        flags = np.zeros(len(whose), np.uint8)
        for n, ids, sizes, data in flagged:
            docs = np.repeat(np.searchsorted(row, np.frombuffer(ids, np.int64)), np.frombuffer(sizes, np.uint32))
            flags[np.searchsorted(whose, docs) + np.frombuffer(data, np.uint32, n)] = np.frombuffer(data, np.uint8, n, 4 * n)
        gone = flags == COVERED
        rows += _spans(row[whose[gone]], first[gone], end[gone], blocks)
        rest = np.flatnonzero(flags == OPEN)
        for b in np.unique(bucket[rest]).tolist():
            mine = rest[bucket[rest] == b]
            ids = np.stack([row[whose[mine]], doc[whose[mine]], at[mine], low[mine], high[mine]])
            near = raw[np.clip(byte[mine][:, None] + np.arange(-BEFORE, BEHIND), 0, len(raw) - 1)]
            rows.append((b, CONTEXT, 0, ids, np.zeros(0), near.tobytes()))
        hot = np.flatnonzero(flags == HOT)
        of, distance, value = _window_hashes(raw, byte[hot], low[hot], high[hot])
        whose, start = whose[hot[of]], at[hot[of]] + distance
        later = _later(value, doc[whose])
        rows += _spans(row[whose[later]], start[later], start[later] + WINDOW, blocks)
        whose, start, value = whose[~later], start[~later], value[~later]
        part = _bucket(value, buckets)
        order = np.argsort(part, kind="stable")
        edge = np.searchsorted(part[order], np.arange(buckets + 1))
        for b in np.flatnonzero(np.diff(edge)).tolist():
            mine = order[edge[b] : edge[b + 1]]
            rows.append((b, WINDOWS, 0, np.stack([row[whose[mine]], doc[whose[mine]], start[mine]]), np.zeros(0), value[mine].tobytes()))
        return pa.Table.from_batches([_packed(rows)])

    return apply


def msd_groups(strings: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Numbers of groups with equal rows of the byte matrix `strings` within `group`; rows that are alone have -1.
    Each pass orders by the next eight bytes, within the groups so far, and drops rows that are alone."""
    out = np.full(len(strings), -1)
    alive = np.arange(len(strings))
    depth = strings.shape[1]
    group = group.copy()
    for d in range(0, depth, 8):
        digit = np.zeros((len(alive), 8), np.uint8)
        digit[:, : min(8, depth - d)] = strings[alive, d : d + 8]
        digit = digit.view(">u8").ravel().astype(U)
        order = np.lexsort((digit, group[alive]))
        alive, digit = alive[order], digit[order]
        if not len(alive):
            return out
        new = np.concatenate([[True], (digit[1:] != digit[:-1]) | (group[alive][1:] != group[alive][:-1])])
        number = np.cumsum(new) - 1
        keep = np.bincount(number)[number] > 1
        group[alive] = number
        alive = alive[keep]
    out[alive] = group[alive]
    return out


def _match_windows(blocks: int) -> Callable[[pa.Table], pa.Table]:
    """Third digit: spans of the repeated windows among one bucket's contexts, and among its windows of hot grams."""

    def match(table: pa.Table) -> pa.Table:
        found = [(np.zeros(0, np.int64),) * 3]
        held = [(np.frombuffer(i, np.int64).reshape(3, -1), np.frombuffer(data, U)) for _, i, _, data in _rows(table, WINDOWS)]
        if held:
            row, doc, start = np.concatenate([i for i, _ in held], axis=1)
            later = _later(np.concatenate([v for _, v in held]), doc)
            found.append((row[later], start[later], start[later] + WINDOW))
        held = [(np.frombuffer(i, np.int64).reshape(5, -1), np.frombuffer(data, np.uint8).reshape(-1, SPAN)) for _, i, _, data in _rows(table, CONTEXT)]
        if held:
            row, doc, at, low, high = np.concatenate([i for i, _ in held], axis=1)
            near = np.concatenate([x for _, x in held])
            for distance in range(-BEFORE, 1):
                whole = np.flatnonzero((low <= distance) & (distance <= high))
                number = msd_groups(near[whole, distance + BEFORE : distance + BEFORE + WINDOW], np.zeros(len(whole), np.int64))
                whole, number = whole[number >= 0], number[number >= 0]
                if len(whole):
                    bad = whole[_later(number, doc[whole])]
                    found.append((row[bad], at[bad] + distance, at[bad] + distance + WINDOW))
        return pa.Table.from_batches([_packed(_spans(*(np.concatenate(x) for x in zip(*found, strict=True)), blocks))])

    return match


def _cut(table: pa.Table) -> pa.Table:
    """The result rows of one block."""
    row, doc, text = _block_texts(table)
    spans = [(np.frombuffer(ids, np.int64), *np.frombuffer(sizes, np.int64).reshape(2, -1)) for _, ids, sizes, _ in _rows(table, SPANS)]
    of, first, end = (np.concatenate(x) for x in zip(*spans, strict=True)) if spans else [np.zeros(0, np.int64)] * 3
    order = np.argsort(of, kind="stable")
    of, first, end = of[order], first[order], end[order]
    low, high = np.searchsorted(of, row, "left"), np.searchsorted(of, row, "right")
    out: list[list] = [[], [], [], [], []]
    for d, t, a, b in zip(doc.tolist(), text, low.tolist(), high.tolist(), strict=True):
        kept, runs = t, 0
        if b > a:
            depth = np.zeros(len(t) + 1, np.int64)
            np.add.at(depth, first[a:b], 1)
            np.add.at(depth, end[a:b], -1)
            gone = np.cumsum(depth)[:-1] > 0
            runs = int(np.count_nonzero(gone[1:] & ~gone[:-1]) + gone[0])
            kept = np.frombuffer(t, np.uint8)[~gone].tobytes()
        for to, value in zip(out, (d, len(t), len(t) - len(kept), runs, hashlib.sha256(kept).hexdigest()), strict=True):
            to.append(value)
    kinds = [pa.int64()] * 4 + [pa.string()]
    return pa.table([pa.array(o, k) for o, k in zip(out, kinds, strict=True)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def _plan(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Packed texts and packed spans."""
    total = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks, buckets = (max(1, -(-total // size)) for size in (BLOCK_BYTES, BUCKET_BYTES))
    keyed = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("row"), F.coalesce("text", F.lit("")).alias("text"))
    packed = keyed.mapInArrow(_send_texts(blocks), PACKED)
    sent = keyed.mapInArrow(_send_suffixes(buckets, blocks, HOT_SENT), PACKED)
    flags = sent.groupBy("key").applyInArrow(_flag_suffixes(blocks, HOT_OPEN), PACKED)
    marked = staged(packed.unionAll(flags).groupBy("key").applyInArrow(_apply_flags(buckets, blocks), PACKED), "suffix-marks")
    matched = marked.where(F.col("kind").isin(CONTEXT, WINDOWS)).groupBy("key").applyInArrow(_match_windows(blocks), PACKED)
    return packed, marked.where(F.col("kind") == SPANS).unionAll(matched)


def without_repeats(docs: DataFrame) -> DataFrame:
    """For each row of `docs`: doc_id, n_bytes, n_removed, n_spans, kept_sha256, after every byte went that is
    covered by a WINDOW-byte string which also starts in a document with a smaller doc_id.

    Texts are their UTF-8 bytes (null: empty), matches stay inside a document, and all strings are judged on the
    input. Rows with the same doc_id don't take from each other; rows with a null doc_id neither take nor lose.
    Texts shorter than WINDOW lose nothing, no rows give none, other columns are not looked at.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    packed, spans = _plan(docs.where("doc_id IS NOT NULL"))
    cut = packed.unionAll(spans).groupBy("key").applyInArrow(_cut, RESULT)
    empty = F.coalesce("text", F.lit(""))
    none = F.lit(0).cast("long")
    rest = docs.where("doc_id IS NULL").select("doc_id", F.octet_length(empty).cast("long").alias("n_bytes"), none.alias("n_removed"), none.alias("n_spans"), F.sha2(empty, 256).alias("kept_sha256"))
    return cut.unionAll(rest)


RESULT_SQL = """
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS b, octet_length(encode(coalesce(text, '')))::BIGINT AS n FROM documents),
p AS (SELECT doc_id, unnest(range(1, n - 48)) AS i FROM d WHERE n >= 50),
w AS (SELECT p.doc_id, p.i, min(p.doc_id) OVER (PARTITION BY d.b[p.i:p.i + 49]) AS first_doc FROM p JOIN d USING (doc_id)),
c AS (SELECT doc_id, i, (i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 50) IS NOT TRUE AS opens FROM w WHERE first_doc < doc_id),
r AS (SELECT doc_id, i, sum(opens::INT) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM c),
s AS (SELECT doc_id, run, min(i) AS a, max(i) + 49 AS e FROM r GROUP BY doc_id, run),
k AS (
    SELECT doc_id, coalesce(lag(e) OVER o, 0) + 1 AS a, a - 1 AS e FROM s WINDOW o AS (PARTITION BY doc_id ORDER BY run)
    UNION ALL SELECT d.doc_id, coalesce(max(s.e), 0) + 1, max(d.n) FROM d LEFT JOIN s USING (doc_id) GROUP BY d.doc_id
),
t AS (SELECT k.doc_id, string_agg(CASE WHEN k.e >= k.a THEN hex(d.b[k.a:k.e]) ELSE '' END, '' ORDER BY k.a) AS kept FROM k JOIN d USING (doc_id) GROUP BY k.doc_id),
n AS (SELECT doc_id, sum(e - a + 1)::BIGINT AS n_removed, count(*)::BIGINT AS n_spans FROM s GROUP BY doc_id)
SELECT d.doc_id, d.n AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN t USING (doc_id)"""
