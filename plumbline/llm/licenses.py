"""License scans: an exact set-similarity join of text blocks with license templates.

A text block is a window of consecutive words, wherever lines break: a quarter longer than
the template. A window meets a template when it holds at least ``threshold`` of the
template's distinct words. All windows of the whole text count; qualifying ones that overlap
are one block. The words of the templates are ordered by how often they occur in the corpus,
rarest first: every qualifying window holds a word of the template's prefix, so only windows
around such words are looked at. The length filter drops windows with fewer template words
than the required overlap; the positional filter drops windows whose first shared word in the
order leaves too few after it.

Beside that, places where a phrase's words stand consecutively in the whole text are
found, whatever separates them.

Words are runs of ASCII letters and digits and of anything beyond ASCII, lower-cased A-Z.
The templates are a bounded parameter and go to every task; the corpus is read twice, for
the order and for the join, and nothing of it is shuffled but counts of template words.

Defined cases: a null or empty text has no words, places or labels, and score 0; a text
shorter than a window is one window; repeated rows get equal results; an empty table gives an
empty result (the order is then by word); other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import prepare
from plumbline.llm.words import NON_WORD, chunks, word_hashes

# Phrases whose places are reported, with their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
#: Notices and license bodies by which blocks are recognised, with the labels the join gives them.
TEMPLATES = {
    "gpl-notice": "this work is licensed under the gnu general public license version 3",
    "apache-notice": "licensed under the apache license version 2 0",
    "cc-by-notice": "licensed under cc by 4 0",
    "cc-by-nc-notice": "licensed under cc by nc 4 0",
    "cc-by-sa-notice": "licensed under cc by sa 4 0",
    "mit-notice": "released under the mit license",
    "bsd-notice": "redistribution and use in source and binary forms with or without modification are permitted",
    "rights-notice": "all rights reserved",
    "mit-body": "permission is hereby granted free of charge to any person obtaining a copy of this software and "
    "associated documentation files the software to deal in the software without restriction including without "
    "limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software "
    "and to permit persons to whom the software is furnished to do so subject to the following conditions",
    "isc-body": "permission to use copy modify and or distribute this software for any purpose with or without fee is "
    "hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "bsd-body": "redistributions of source code must retain the above copyright notice this list of conditions and the "
    "following disclaimer redistributions in binary form must reproduce the above copyright notice this list of "
    "conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "apache-header": "you may not use this file except in compliance with the license you may obtain a copy of the "
    "license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing "
    "software distributed under the license is distributed on an as is basis without warranties or conditions of any "
    "kind either express or implied",
    "gpl-header": "this program is free software you can redistribute it and or modify it under the terms of the gnu "
    "general public license as published by the free software foundation either version 3 of the license or at your "
    "option any later version",
    "lgpl-header": "this library is free software you can redistribute it and or modify it under the terms of the gnu "
    "lesser general public license as published by the free software foundation",
    "agpl-header": "this program is free software you can redistribute it and or modify it under the terms of the gnu "
    "affero general public license as published by the free software foundation",
    "mpl-header": "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the "
    "mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0",
    "unlicense-body": "this is free and unencumbered software released into the public domain anyone is free to copy "
    "modify publish use compile sell or distribute this software",
    "warranty-disclaimer": "the software is provided as is without warranty of any kind express or implied including but "
    "not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
}
#: Share of a template's distinct words that a block must hold, and words of a window to one of the template.
THRESHOLD, STRETCH = 0.8, 1.25


def _places(hashes: np.ndarray, first: np.ndarray, phrase: np.ndarray) -> np.ndarray:
    """Indexes of words at which the phrase's words stand consecutively within one text."""
    n = len(hashes) - len(phrase) + 1
    if n <= 0:
        return np.empty(0, dtype=np.int64)
    at = np.flatnonzero(hashes[:n] == phrase[0])
    for k in range(1, len(phrase)):
        at = at[hashes[at + k] == phrase[k]]
    text = np.searchsorted(first, at, "right") - 1
    return at[at + len(phrase) <= first[text + 1]]


class Matcher:
    """Templates as sets of ranks in the corpus order, with their prefixes."""

    def __init__(self, templates: Mapping[str, str], frequency: Mapping[int, int], threshold: float):
        self.names = sorted(templates)
        hashes, first = word_hashes([templates[n] for n in self.names], NON_WORD)
        self.vocabulary = np.unique(hashes)
        order = sorted(self.vocabulary.tolist(), key=lambda h: (frequency.get(h, 0), h))
        rank = {h: r for r, h in enumerate(order)}
        self.rank = np.array([rank[h] for h in self.vocabulary.tolist()], dtype=np.int64)
        self.width = [int(np.ceil(STRETCH * (b - a) - 1e-9)) for a, b in zip(first, first[1:])]
        self.need, self.place, self.size = [], [], []
        prefix = set()
        for a, b in zip(first, first[1:]):
            words = sorted({rank[h] for h in hashes[a:b].tolist()})
            need = max(1, int(np.ceil(threshold * len(words) - 1e-9)))
            place = np.full(len(order), -1, dtype=np.int64)  # of each rank in the template's order
            place[words] = np.arange(len(words))
            self.need.append(need)
            self.place.append(place)
            self.size.append(len(words))
            prefix.update(order[r] for r in words[: len(words) - need + 1])
        self.prefix = np.sort(np.array(list(prefix), dtype=np.uint64))

    def has_prefix(self, hashes: np.ndarray) -> np.ndarray:
        """Places of words that are in the prefix of a template."""
        if not len(self.prefix):
            return np.empty(0, dtype=np.int64)
        at = np.searchsorted(self.prefix, hashes).clip(0, len(self.prefix) - 1)
        return np.flatnonzero(self.prefix[at] == hashes)

    def blocks(self, hashes: np.ndarray) -> list[tuple[int, int, str, float]]:
        """Blocks of a text's words: first word, word after the last, template, share of it."""
        at = np.searchsorted(self.vocabulary, hashes).clip(0, len(self.vocabulary) - 1)
        known = np.flatnonzero(self.vocabulary[at] == hashes)
        ranks = self.rank[at[known]]
        out = []
        for t, name in enumerate(self.names):
            mine = self.place[t][ranks]
            where, places = known[mine >= 0], mine[mine >= 0]
            if len(places):
                out += [(a, b, name, share) for a, b, share in self._met(t, where, places)]
        return sorted(out)

    def _met(self, t: int, where: np.ndarray, places: np.ndarray) -> list[tuple[int, int, float]]:
        need, size = self.need[t], self.size[t]
        # A window ends at each of the template's words and begins at the first one within its width.
        end = np.arange(len(where)) + 1
        begin = np.searchsorted(where, where - self.width[t], "right")
        rare = np.concatenate([[0], np.cumsum(places <= size - need)])
        wanted = np.flatnonzero((end - begin >= need) & (rare[end] > rare[begin]))
        out: list[list] = []
        for last in wanted.tolist():
            a = int(begin[last])
            have = np.unique(places[a : last + 1])
            if size - have[0] < need or len(have) < need:  # position, overlap
                continue
            share, start, stop = len(have) / size, int(where[a]), int(where[last]) + 1
            if out and start < out[-1][1]:
                out[-1] = [out[-1][0], stop, max(out[-1][2], share)]
            else:
                out.append([start, stop, share])
        return [tuple(b) for b in out]


def word_frequency(docs: DataFrame, vocabulary: np.ndarray) -> dict[int, int]:
    """How often each word of the templates occurs in the whole corpus."""
    known = vocabulary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = np.zeros(len(known), dtype=np.int64)
        for b in batches:
            texts = [t for t in b.column(0).to_pylist() if t]
            for begin, end in chunks(texts) if len(known) else ():
                hashes, _ = word_hashes(texts[begin:end], NON_WORD)
                at = np.searchsorted(known, hashes).clip(0, len(known) - 1)
                count += np.bincount(at[known[at] == hashes], minlength=len(known))
        yield pa.RecordBatch.from_arrays([pa.array(known.astype(np.int64)), pa.array(count)], ["word", "n"])

    found = docs.select("text").mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return {int(np.int64(r["word"]).astype(np.uint64)): r["n"] for r in found.collect()}


def scan(
    docs: DataFrame,
    templates: Mapping[str, str] = TEMPLATES,
    phrases: Mapping[str, str] = PHRASES,
    threshold: float = THRESHOLD,
    text: str = "text",
    key: str = "doc_id",
) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_base, first_word, last_word, base_labels,
    labels (both comma-joined), blocks (first word, word after the last, template and the share
    of it that is met, in order of the text) and score, the largest share, 1 with a phrase."""
    prepare(docs.sparkSession)
    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    vocabulary = Matcher(templates, {}, threshold).vocabulary
    frequency = word_frequency(rows, vocabulary)
    kinds = {
        "doc_id": kind,
        "n_words": "long",
        "n_base": "long",
        "first_word": "long",
        "last_word": "long",
        "base_labels": "string",
        "labels": "string",
        "score": "double",
        "blocks": "array<struct<start:int,end:int,template:string,share:double>>",
    }
    block_type = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("template", pa.string()), ("share", pa.float64())]))
    types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), block_type]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(templates, frequency, threshold)
        wanted = {label: [] for label in phrases.values()}
        for phrase, label in phrases.items():
            wanted[label].append(word_hashes([phrase], NON_WORD)[0])
        for b in batches:
            texts, out = [t or "" for t in b.column(1).to_pylist()], []
            for begin, end in chunks(texts):
                out.extend(_judge(texts[begin:end], matcher, wanted))
            columns = list(zip(*out)) or [[]] * len(types)
            arrays = [pa.array(c, t) for c, t in zip(columns, types)]
            yield pa.RecordBatch.from_arrays([b.column(0), *arrays], list(kinds))

    return rows.mapInArrow(run, ", ".join(f"{c} {t}" for c, t in kinds.items()))


def _judge(texts: list[str], matcher: Matcher, wanted: Mapping[str, list[np.ndarray]]) -> list[tuple]:
    hashes, first = word_hashes(texts, NON_WORD)
    places: dict[int, list[int]] = {}
    labels: dict[int, set[str]] = {}
    for label, patterns in wanted.items():
        for pattern in patterns:
            at = _places(hashes, first, pattern)
            for text, word in zip((np.searchsorted(first, at, "right") - 1).tolist(), at.tolist()):
                places.setdefault(text, []).append(word - int(first[text]))
                labels.setdefault(text, set()).add(label)
    blocks: dict[int, list[tuple[int, int, str, float]]] = {}
    for text in np.unique(np.searchsorted(first, matcher.has_prefix(hashes), "right") - 1).tolist():
        blocks[text] = matcher.blocks(hashes[first[text] : first[text + 1]])
    out = []
    for text, n in enumerate(np.diff(first).tolist()):
        at, base, found = places.get(text, []), labels.get(text, set()), blocks.get(text, [])
        own = {name for _, _, name, _ in found}
        score = 1.0 if at else max((share for *_, share in found), default=0.0)
        out.append(
            (
                n,
                len(at),
                min(at, default=None),
                max(at, default=None),
                ",".join(sorted(base)),
                ",".join(sorted(base | own)),
                score,
                found,
            )
        )
    return out
