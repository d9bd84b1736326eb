"""License scans: an index of where each template's rarest words stand in it is looked up with those words of a file;
postings that agree on a relative position are candidates, and their mandatory phrases are verified."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldloom.llm.batches import PUNCTUATION, U, mix64, texts, words
from fieldloom.llm.sums import BLOB, gathered, pieces

# Phrases that name a license by themselves, and the label of each.
BASE = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)
#: Other phrases that do, found in the same way.
NAMES = (
    ("apache license version 2 0", "apache-2.0"),
    ("gnu general public license version 2", "gpl-2.0"),
    ("gnu general public license version 3", "gpl-3.0"),
    ("gnu lesser general public license", "lgpl"),
    ("gnu affero general public license", "agpl"),
    ("cc by nc", "cc-by-nc"),
    ("cc by nd", "cc-by-nd"),
    ("cc by sa", "cc-by-sa"),
    ("creative commons attribution", "cc-by"),
    ("mozilla public license", "mpl"),
    ("eclipse public license", "epl"),
    ("boost software license", "bsl"),
    ("bsd license", "bsd"),
    ("isc license", "isc"),
    ("zlib license", "zlib"),
    ("the unlicense", "unlicense"),
    ("spdx license identifier mit", "mit"),
    ("spdx license identifier apache 2 0", "apache-2.0"),
    ("spdx license identifier bsd 2 clause", "bsd-2-clause"),
    ("spdx license identifier bsd 3 clause", "bsd-3-clause"),
    ("spdx license identifier gpl 2 0", "gpl-2.0"),
    ("spdx license identifier gpl 3 0", "gpl-3.0"),
)
# The wording of public licenses and notices that files carry without naming them, each with the phrases that
# must be there.
WORDINGS = (
    (
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        ("permission is hereby granted free of charge", "without restriction", "substantial portions of the software"),
    ),
    (
        "isc",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        ("for any purpose with or without fee is hereby granted", "appear in all copies"),
    ),
    (
        "bsd-2-clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        ("redistributions of source code must retain", "redistributions in binary form must reproduce"),
    ),
    (
        "bsd-3-clause",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        ("redistributions in binary form must reproduce", "endorse or promote products derived from this software"),
    ),
    (
        "apache-2.0",
        "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
        ("may not use this file except in compliance with the license", "without warranties or conditions of any kind"),
    ),
    (
        "gpl",
        "is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version of the License, or (at your option) any later version.",
        ("is free software", "gnu general public license as published by the free software foundation"),
    ),
    (
        "lgpl",
        "is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version of the License, or (at your option) any later version.",
        ("is free software", "lesser general public license as published by the free software foundation"),
    ),
    (
        "mpl-2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
        ("source code form is subject to the terms of the mozilla public license", "if a copy of the mpl was not distributed with this file"),
    ),
    (
        "bsl",
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the Software) to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software",
        ("permission is hereby granted free of charge", "use reproduce display distribute execute and transmit the software"),
    ),
    (
        "zlib",
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: The origin of this software must not be misrepresented; you must not claim that you wrote the original software.",
        ("including commercial applications and to alter it and redistribute it freely", "must not be misrepresented"),
    ),
    (
        "unlicense",
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
        ("free and unencumbered software released into the public domain",),
    ),
)

#: Of a wording so many of its rarest words are in the index; of a name one is.
RARE = 12
#: A wording is a candidate where so many of those stand at one relative position (to WIDTH words, for edits) or more.
AGREE, WIDTH = 3, 32
#: A wording is found if its mandatory phrases are within its place, WIDTH words more at either end, and so large a share of its
#: words.
SHARE = 0.6
RESULT = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"
_Q = [pow(0x9FB21C651E98DF25, k + 1, 1 << 64) for k in range(64)]


def _hashes(text: str) -> np.ndarray:
    (t,) = texts(pa.array([text]))
    return words(t, PUNCTUATION).hash


@dataclass
class Template:
    label: str
    words: np.ndarray
    base: bool = False
    #: Empty for names, of which every word must be there.
    phrases: tuple[np.ndarray, ...] = ()


def templates() -> list[Template]:
    out = [Template(label, _hashes(x), True) for x, label in BASE] + [Template(label, _hashes(x)) for x, label in NAMES]
    return out + [Template(label, _hashes(x), False, tuple(map(_hashes, phrases))) for label, x, phrases in WORDINGS]


def licence_words(known: list[Template]) -> np.ndarray:
    """All templates' words, sorted."""
    return np.unique(np.concatenate([t.words for t in known]))


def document_counts(docs: DataFrame, vocabulary: np.ndarray) -> np.ndarray:
    """In how many rows of `docs` each of the sorted words stands; the last entry counts the rows."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(vocabulary) + 1, np.int64)
        for batch in batches:
            total[-1] += batch.num_rows
            for t in texts(batch.column(0)):
                w = words(t, PUNCTUATION)
                at = np.minimum(np.searchsorted(vocabulary, w.hash), len(vocabulary) - 1)
                hit = np.flatnonzero(vocabulary[at] == w.hash)
                text = np.searchsorted(w.first, hit, "right") - 1
                total[:-1] += np.bincount(np.unique(text * len(vocabulary) + at[hit]) % len(vocabulary), minlength=len(vocabulary))
        yield pieces(total, 1.0)

    found = gathered(docs.select("text").mapInArrow(count, BLOB), np.int64, mean=False)
    return found if len(found) else np.zeros(len(vocabulary) + 1, np.int64)


@dataclass
class Index:
    """Postings (template, place) of the templates' rarest words: word k of the sorted `keys` has those from first[k] on."""

    known: list[Template]
    keys: np.ndarray
    first: np.ndarray
    template: np.ndarray
    place: np.ndarray

    @classmethod
    def of(cls, known: list[Template], vocabulary: np.ndarray, counts: np.ndarray) -> Index:
        """counts: in how many documents each word of the vocabulary stands, and how many there are."""
        idf = np.log((1 + counts[-1]) / (1 + counts[:-1]))
        rows = []
        for k, t in enumerate(known):
            own = np.unique(t.words)
            place = np.array([np.flatnonzero(t.words == x)[0] for x in own])
            order = np.lexsort((place, -idf[np.searchsorted(vocabulary, own)]))
            rare = own[order[: RARE if t.phrases else 1]]
            # each place of a wording's rare words; of a name the first is enough
            places = np.flatnonzero(np.isin(t.words, rare)) if t.phrases else np.flatnonzero(t.words == rare[0])[:1]
            rows += [(int(t.words[p]), k, int(p)) for p in places]
        word, template, place = (np.array(x, kind) for x, kind in zip(zip(*sorted(rows), strict=True), (U, np.int64, np.int64), strict=True))
        keys, first = np.unique(word, return_index=True)
        return cls(known, keys, np.append(first, len(word)), template, place)

    def postings(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(template, place of the word in it, place of the word in `h`) of every word that is in the index."""
        k = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
        at = np.flatnonzero(self.keys[k] == h)
        k = k[at]
        n = self.first[k + 1] - self.first[k]
        each = np.repeat(self.first[k] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum()) if len(at) else np.zeros(0, np.int64)
        return self.template[each], self.place[each], np.repeat(at, n)


def _stands(h: np.ndarray, phrase: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Whether the phrase's words stand at each of the places."""
    good = (begin >= 0) & (begin + len(phrase) <= len(h))
    for k, x in enumerate(phrase):
        good[good] = h[begin[good] + k] == x
    return good


def _run_hash(h: np.ndarray) -> np.ndarray:
    """Of each three words that follow each other."""
    return mix64(h[:-2] * U(_Q[0]) + h[1:-1] * U(_Q[1]) + h[2:] * U(_Q[2])) if len(h) > 2 else np.zeros(0, U)


def find(index: Index, h: np.ndarray, first: np.ndarray) -> Iterator[tuple[int, int, int, float]]:
    """(text, template, first word in the text, share of the template's words that stand there) of every place at which
    a name stands, and of every wording that is verified."""
    template, place, at = index.postings(h)
    text = np.searchsorted(first, at, "right") - 1
    begin = at - place
    for k in np.unique(template).tolist():
        own, t = np.flatnonzero(template == k), index.known[k]
        own = own[np.argsort(begin[own], kind="stable")]
        if not t.phrases:
            some = own[_stands(h, t.words, begin[own])]
            some = some[(begin[some] >= first[text[some]]) & (begin[some] + len(t.words) <= first[text[some] + 1])]
            yield from ((int(text[i]), k, int(begin[i] - first[text[i]]), 1.0) for i in some)
            continue
        # runs of postings of one text whose relative positions are within WIDTH of the next
        cut = np.flatnonzero((np.diff(begin[own]) > WIDTH) | (np.diff(text[own]) != 0)) + 1
        sought = np.unique(_run_hash(t.words))
        for run in np.split(own, cut):
            if len(np.unique(place[run])) < AGREE:
                continue
            i = int(text[run[0]])
            low, high = max(int(first[i]), int(begin[run].min()) - WIDTH), min(int(first[i + 1]), int(begin[run].max()) + len(t.words) + WIDTH)
            here = h[low:high]
            if not all(_stands(here, p, np.flatnonzero(here == p[0])).any() for p in t.phrases):
                continue
            share = float(np.isin(sought, _run_hash(here)).mean())
            if share >= SHARE:
                yield i, k, int(begin[run].min() - first[i]), min(share, 1.0)


def scanned(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score) of every row.

    Words are runs of letters, digits and non-ASCII characters, A-Z lower-cased. n_base counts the places of the phrases
    of BASE, whose smallest and largest start are first_word and last_word, null without any; labels has those of
    NAMES and WORDINGS too, sorted, each once; score is the largest share of a template that stands in the text, 0
    without any. Which words are rare is told by the documents that hold them, counted over all rows; that decides where
    it is looked for names, not which are found. A null text is empty; repeated and null doc_ids come out as they
    are, other columns are not looked at; no rows give none.
    """
    known = templates()
    vocabulary = licence_words(known)
    sent = docs.sparkSession.sparkContext.broadcast(Index.of(known, vocabulary, document_counts(docs, vocabulary)))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in texts(batch.column(1)):
                index, w, n = sent.value, words(t, PUNCTUATION), len(t)
                base, low, high, score = np.zeros(n, np.int64), np.full(n, 1 << 62), np.full(n, -1), np.zeros(n)
                base_labels, labels = ([set() for _ in range(n)] for _ in range(2))
                for i, k, start, share in find(index, w.hash, w.first):
                    own = index.known[k]
                    labels[i].add(own.label)
                    score[i] = max(score[i], share)
                    if own.base:
                        base[i] += 1
                        low[i], high[i] = min(low[i], start), max(high[i], start)
                        base_labels[i].add(own.label)
                none = base == 0
                names = [pa.array([",".join(sorted(x)) for x in some], pa.string()) for some in (base_labels, labels)]
                columns = [batch.column(0).slice(t.first, n), pa.array(np.diff(w.first)), pa.array(base), pa.array(low, mask=none), pa.array(high, mask=none), *names, pa.array(score)]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(scan, RESULT)


def without_labels(docs: DataFrame, labels: Column | list[str]) -> DataFrame:
    """The documents, all columns, in which none of the `labels` is found; rows of one doc_id go together, those with
    a null doc_id too."""
    wanted = F.array(*map(F.lit, labels)) if isinstance(labels, list) else labels
    bad = scanned(docs).where(F.arrays_overlap(F.split("labels", ","), wanted)).select(F.col("doc_id").alias("labelled_doc_id")).distinct()
    return docs.join(bad, F.col("doc_id").cast("long").eqNullSafe(F.col("labelled_doc_id")), "left_anti")
