"""Licence scan by a positional index of rare words.

Every template (a licence notice, or one of the phrases of the base) is indexed by its rarest words, by
their document frequency in the corpus, with the places where they stand.  A file's words are looked up
there, its highest-IDF licence words are the ones that are found; postings of a template meet by relative
position (word of the file minus word of the template, give or take SLACK), and where enough of the
template's IDF weight meets, the mandatory phrases are verified word by word.

Two scans without any exchange but one row a licence word and task: document frequencies, then the files.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronovox.llm.common import batched, table, text_views

#: Phrases of the base and their labels.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

#: Label, words of a usual notice, and the phrases that must stand in it word by word.
NOTICES = (
    ("mit", "released under the mit license", ("the mit license",)),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software", ("permission is hereby granted free of charge", "deal in the software without restriction")),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies", ("for any purpose with or without fee is hereby granted", "appear in all copies")),
    ("bsd-2-clause", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright notice", ("redistribution and use in source and binary forms", "redistributions of source code must retain")),
    ("bsd-3-clause", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", ("neither the name of", "used to endorse or promote products derived from this software")),
    ("apache-2.0", "licensed under the apache license version 2 0", ("apache license version 2 0",)),
    ("apache-2.0", "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied", ("you may not use this file except in compliance with the license", "unless required by applicable law or agreed to in writing")),
    ("gpl-3.0", "licensed under the gnu general public license version 3", ("gnu general public license version 3",)),
    ("gpl-3.0", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version", ("the gnu general public license as published by", "version 3 of the license")),
    ("gpl-2.0", "licensed under the gnu general public license version 2", ("gnu general public license version 2",)),
    ("gpl-2.0", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version", ("the gnu general public license as published by", "version 2 of the license")),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation", ("gnu lesser general public license",)),
    ("agpl-3.0", "you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license", ("gnu affero general public license", "version 3 of the license")),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0", ("mozilla public license v 2 0",)),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0", ("cc by nc 4 0",)),
    ("cc-by-sa-4.0", "licensed under cc by sa 4 0", ("cc by sa 4 0",)),
    ("cc-by-4.0", "licensed under cc by 4 0", ("cc by 4 0",)),
    ("cc-by-4.0", "this work is licensed under a creative commons attribution 4 0 international license", ("creative commons attribution 4 0 international license",)),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely", ("permission is granted to anyone to use this software for any purpose", "alter it and redistribute it freely")),
    ("unlicense", "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software", ("free and unencumbered software released into the public domain",)),
)

#: A label that stands for more of the text than another: where places of both overlap, the second goes.
BEATS = (("bsd-3-clause", "bsd-2-clause"),)
#: Words of a template that are indexed: its rarest, this many at most and half of its different words.
RARE_WORDS = 12
#: Share of a notice's indexed IDF weight that must meet at one relative position.
LEAST_SHARE = 0.7
#: Words that may be missing or inserted within a notice.
SLACK = 8
FOUND = "doc_id long, n_words long, places array<struct<label: string, base: boolean, start: long, end: long, share: double>>, near double"


@dataclass(frozen=True)
class Template:
    label: str
    base: bool
    words: tuple[int, ...]
    rare: tuple[tuple[int, float, tuple[int, ...]], ...]  # word, IDF, places in the template
    keys: tuple[tuple[tuple[int, ...], int, int], ...]  # words of a mandatory phrase, place of its rarest, place in the template


@dataclass(frozen=True)
class Index:
    vocabulary: tuple[str, ...]
    templates: tuple[Template, ...]


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_WORD = np.zeros(256, bool)
_IS_WORD[48:58] = _IS_WORD[97:123] = _IS_WORD[128:] = True


def _stream(data: np.ndarray, off: np.ndarray, vocabulary: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(vocabulary number of every word or -1, first word of each text and the end) of a slice of texts."""
    low = _LOWER[data]
    is_word = _IS_WORD[low]
    fresh = is_word.copy()
    fresh[1:] &= ~is_word[:-1]
    heads = off[:-1][off[:-1] < off[1:]]
    fresh[heads] = is_word[heads]
    starts = np.flatnonzero(fresh)
    letters = np.concatenate([[0], np.cumsum(is_word)])
    bounds = np.concatenate([letters[starts], letters[-1:]]).astype(np.int64)
    words = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(low[is_word]))])
    ids = np.asarray(pc.fill_null(pc.index_in(words, value_set=vocabulary), -1)).astype(np.int64)
    return ids, np.searchsorted(starts, off)


def _vocabulary(notices, phrases) -> list[str]:
    return sorted({w for _, text, keys in notices for part in (text, *keys) for w in part.split()} | {w for p in phrases for w in p.split()})


def document_frequencies(docs: DataFrame, vocabulary: list[str]) -> tuple[int, dict[str, int]]:
    """Number of documents, and in how many of them each licence word stands: whole texts, all rows."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, n, seen = pa.array([w.encode() for w in vocabulary], pa.large_binary()), 0, np.zeros(len(vocabulary), np.int64)
        for batch in batches:
            n += batch.num_rows
            for _, _, data, off in text_views(batch):
                ids, at = _stream(data, off, known)
                doc = np.repeat(np.arange(len(off) - 1), np.diff(at))
                hit = ids >= 0
                seen += np.bincount(np.unique(doc[hit] * len(vocabulary) + ids[hit]) % len(vocabulary), minlength=len(vocabulary))
        yield pa.RecordBatch.from_pydict({"word": pa.array(np.arange(-1, len(vocabulary)), pa.int32()), "n": pa.array(np.concatenate([[n], seen]), pa.int64())})

    rows = batched(docs.select(F.col("text").cast("string").alias("text"))).mapInArrow(count, "word int, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()  # a row a licence word
    got = {r.word: r.n for r in rows}
    return got.get(-1, 0), {w: got.get(i, 0) for i, w in enumerate(vocabulary)}


def build_index(docs: DataFrame, notices=NOTICES, phrases=None) -> Index:
    """The index of the templates' rarest words in docs; ties go to the first in the alphabet."""
    phrases = PHRASES if phrases is None else phrases
    vocabulary = _vocabulary(notices, phrases)
    n, df = document_frequencies(docs, vocabulary)
    number = {w: i for i, w in enumerate(vocabulary)}
    idf = {w: math.log((n + 1) / (df[w] + 1)) + 1e-3 for w in vocabulary}

    def key(phrase: str, text: list[str]):
        words = phrase.split()
        at = next(i for i in range(len(text)) if text[i : i + len(words)] == words)
        return tuple(number[w] for w in words), min(range(len(words)), key=lambda i: (-idf[words[i]], i)), at

    made = []
    for label, text, keys, base in [(v, p, (p,), True) for p, v in phrases.items()] + [(*x, False) for x in notices]:
        words = text.split()
        most = 1 if base else min(RARE_WORDS, (len(set(words)) + 1) // 2)
        rare = sorted(set(words), key=lambda w: (-idf[w], w))[:most]
        made.append(Template(label, base, tuple(number[w] for w in words), tuple((number[w], idf[w], tuple(i for i, x in enumerate(words) if x == w)) for w in rare), tuple(key(k, words) for k in keys)))
    return Index(tuple(vocabulary), tuple(made))


class _Slice:
    """The words of a slice of texts, with the places of each licence word."""

    def __init__(self, ids: np.ndarray, at: np.ndarray, gap: int):
        self.ids, self.first = ids, at
        self.doc = np.repeat(np.arange(len(at) - 1), np.diff(at))
        self.gap = gap  # texts lie so far apart that no template reaches from one into the next
        hits = np.flatnonzero(ids >= 0)
        order = np.argsort(ids[hits], kind="stable")
        self._hits, self._words = hits[order], ids[hits][order]

    def places(self, word: int) -> np.ndarray:
        lo, hi = np.searchsorted(self._words, [word, word + 1])
        return self._hits[lo:hi]

    def phrase(self, words: tuple[int, ...], rarest: int) -> np.ndarray:
        """First words of all places where the phrase stands in one text, found by its rarest word."""
        start = self.places(words[rarest]) - rarest
        start = start[(start >= 0) & (start + len(words) <= len(self.ids))]
        for k, w in enumerate(words):
            start = start[self.ids[start + k] == w]
        return start[self.doc[start] == self.doc[start + len(words) - 1]]

    def spread(self, start: np.ndarray) -> np.ndarray:
        return start + self.doc[start] * self.gap


def _aligned(part: _Slice, template: Template) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place of a template's first word, share of its indexed weight there, a word of the file), by postings that meet."""
    hits = [(w, weight, part.places(w), np.array(at)) for w, weight, at in template.rare]
    shifts, seen = [], []
    for _, _, p, at in hits:
        shifts.append(np.sort((part.spread(p)[:, None] - at[None, :]).ravel()))
        seen.append(np.repeat(p, len(at)))
    every = np.concatenate(shifts)
    if not len(every):
        return every, every.astype(float), every
    start, index = np.unique(np.concatenate([(part.spread(p)[:, None] - at[None, :]).ravel() for _, _, p, at in hits]), return_index=True)
    share = np.zeros(len(start))
    for (_, weight, _, _), s in zip(hits, shifts, strict=True):
        near = np.searchsorted(s, start)
        share += weight * (s[np.minimum(near, len(s) - 1)] - start <= SLACK) * (near < len(s)) if len(s) else 0.0
    return start, share / sum(w for _, w, _ in template.rare), np.concatenate(seen)[index]


def _found(part: _Slice, template: Template) -> list[tuple[int, str, bool, int, int, float, bool]]:
    """(text, label, base, first word, end, share, whether all mandatory phrases stand there)."""
    n = len(template.words)
    if template.base:
        start = part.phrase(*template.keys[0][:2])
        doc = part.doc[start]
        return [(d, template.label, True, s, s + n, 1.0, True) for d, s in zip(doc.tolist(), (start - part.first[doc]).tolist(), strict=True)]
    start, share, word = _aligned(part, template)
    keep = share >= LEAST_SHARE - 1e-9
    start, share, word = start[keep], share[keep], word[keep]
    if not len(start):
        return []
    whole = np.ones(len(start), bool)
    for words, rarest, at in template.keys:
        there = np.sort(part.spread(part.phrase(words, rarest)) - at)
        near = np.searchsorted(there, start - SLACK)
        whole &= (near < len(there)) & (there[np.minimum(near, len(there) - 1)] <= start + 2 * SLACK) if len(there) else False
    out, doc = [], part.doc[word]
    begin = start - doc * part.gap - part.first[doc]
    # places that overlap are one: the best of them, verified ones first
    order, last = np.lexsort((begin, doc)), None
    for i in order.tolist():
        row = (int(doc[i]), template.label, False, max(0, int(begin[i])), min(int(begin[i]) + n + SLACK, int(part.first[doc[i] + 1] - part.first[doc[i]])), min(1.0, float(share[i])), bool(whole[i]))
        if last is not None and row[0] == out[-1][0] and int(begin[i]) - last < n:
            if (row[6], row[5]) > (out[-1][6], out[-1][5]):
                out[-1] = row
        else:
            out.append(row)
            last = int(begin[i])
    return out


def find_licenses(docs: DataFrame, index: Index) -> DataFrame:
    """doc_id, n_words, places (label, base, start, end in words, share), near of every row of docs.

    near is the best share of a notice whose mandatory phrases are not all there.  A null text is empty,
    has no words and no places; repeated rows, ties and null doc_ids are rows like others; further
    columns, of whatever names, are left aside; no rows give no rows.
    """
    gap = max(len(t.words) for t in index.templates) + 4 * SLACK

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pa.array([w.encode() for w in index.vocabulary], pa.large_binary())
        for batch in batches:
            for first, end, data, off in text_views(batch):
                ids, at = _stream(data, off, known)
                part = _Slice(ids, at, gap)
                rows: dict[int, list] = {}
                near: dict[int, float] = {}
                for template in index.templates:
                    for d, label, base, a, b, share, whole in _found(part, template):
                        if whole:
                            rows.setdefault(d, []).append({"label": label, "base": base, "start": a, "end": b, "share": share})
                        else:
                            near[d] = max(near.get(d, 0.0), share)
                n = end - first
                for better, other in BEATS:
                    for d, got in rows.items():
                        won = [x for x in got if x["label"] == better]
                        rows[d] = [x for x in got if x["label"] != other or not any(x["start"] < y["end"] and y["start"] < x["end"] for y in won)]
                kind = pa.list_(pa.struct([("label", pa.string()), ("base", pa.bool_()), ("start", pa.int64()), ("end", pa.int64()), ("share", pa.float64())]))
                yield pa.RecordBatch.from_pydict({
                    "doc_id": batch.column(batch.schema.get_field_index("doc_id")).slice(first, n).cast(pa.int64()), "n_words": pa.array(np.diff(at), pa.int64()),
                    "places": pa.array([rows.get(i, []) for i in range(n)], kind), "near": pa.array([near.get(i, 0.0) for i in range(n)], pa.float64()),
                })

    return batched(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))).mapInArrow(scan, FOUND)


def _labels(places: Column) -> Column:
    return F.array_join(F.array_sort(F.array_distinct(F.transform(places, lambda x: x["label"]))), ",")


def scan_licenses(docs: DataFrame, index: Index) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score: see find_licenses.

    score is the best share of a notice, or 1 for a phrase of the base; half of a notice's share where a
    mandatory phrase is missing; 0 without any."""
    found = find_licenses(docs, index)
    base = F.filter("places", lambda x: x["base"])
    starts = F.transform(base, lambda x: x["start"])
    best = F.coalesce(F.array_max(F.transform("places", lambda x: x["share"])), F.lit(0.0))
    return found.select(
        "doc_id", "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        _labels(base).alias("base_labels"), _labels(F.col("places")).alias("labels"), F.greatest(best, F.col("near") / 2).alias("score"),
    )


def op12_licenses(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return scan_licenses(docs, build_index(docs))
