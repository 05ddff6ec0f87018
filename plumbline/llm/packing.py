"""Packing: documents into sequences of several context sizes, hierarchically.

Each document becomes token ids and an end id. Whole longest windows are cut off first;
what remains is routed to the tier of the smallest context size that holds it. Tiers are
packed from the longest to the shortest: an item opens a window of its tier's size, the
largest shorter items that fit fill it up, and the last gap takes the front of the
shortest item left, whose rest goes back to its tier. Every window is full, so that
nothing is padded but one last sequence per input partition. Sequences are dealt to step
groups by descending length, each to the group with the fewest tokens.

A task works through its partition in portions of bounded size and carries the items of
an open window on; nothing is shuffled. Sequence ids hold the partition's number, so a
task that runs again gives whole sequences of its own.

Defined cases: a null or empty text is the end id alone; repeated rows, and rows with a
null doc_id, are packed one by one; very long texts fill windows of their own; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import heapq
import os
import zlib
from bisect import bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import prepare, tidy
from plumbline.llm.words import BLANK, Words, chunks

#: Context sizes, longest first; token that ends a document.
TIERS, END = (2048, 1024, 512, 256), 1
#: Tokens packed at once, and tokens of a step group.
PORTION, STEP_TOKENS = 500_000, 65_536
#: Entries of a task's memo of encoded words, and new words encoded at once.
MEMO, WORDS = 400_000, 20_000
#: Characters encoded at once.
CHUNK = 2 << 20


#: Stands between words that are encoded as one text, which costs less than one text a word.
MARK, RUN = "\x01", 250


class Encoder:
    """Token ids of texts, as little-endian 32-bit bytes.

    The vocabulary drops white space and never joins across it, so a text's ids are those
    of its parts between blanks and newlines, in either case of ASCII letters. Parts recur,
    so each is encoded once and found by a 64-bit hash; those longest unused are forgotten
    first. Texts with the string of a special token are encoded whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        a, mark, b, both = (e.tolist() for e in self.encode(["a", MARK, "b", f"a {MARK} b"]))
        self.mark = mark[0] if len(mark) == 1 and both == [*a, *mark, *b] else None
        # Known words by ascending hash: when each was last used, and its run in ``ids``.
        self.keys, self.used = np.empty(0, dtype=np.uint64), np.empty(0, dtype=np.int64)
        self.begins, self.sizes = np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
        self.ids, self.calls = np.empty(0, dtype="<u4"), 0

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, dtype="<u4") for e in found]

    def words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Number of ids of each word, and the ids of all in a row."""
        sizes, ids = [], []
        for i in range(0, len(words), WORDS):
            some = words[i : i + WORDS]
            runs = [some[j : j + RUN] for j in range(0, len(some), RUN)]
            if self.mark is None or any(MARK in w for w in some):
                runs = [[w] for w in some]
            for run, e in zip(runs, self.encode([f" {MARK} ".join(r) for r in runs])):
                if len(run) > 1:
                    marks = np.flatnonzero(e == self.mark)
                    sizes.append(np.diff(marks, prepend=-1, append=len(e)) - 1)
                    e = np.delete(e, marks)
                else:
                    sizes.append([len(e)])
                ids.append(e)
        if not ids:
            return self.sizes[:0], self.ids[:0]
        return np.concatenate(sizes).astype(np.int64), np.concatenate(ids)

    def known(self, w: Words, distinct: np.ndarray, sample: np.ndarray) -> np.ndarray:
        """Places of the distinct words among the known ones; new words are encoded."""
        self.calls += 1
        at = np.searchsorted(self.keys, distinct)
        new = np.ones(len(distinct), dtype=bool)
        inside = at < len(self.keys)
        new[inside] = self.keys[at[inside]] != distinct[inside]
        if len(self.keys) + new.sum() > MEMO:
            self._forget(at[~new])
            at = np.searchsorted(self.keys, distinct)
        first = sample[new]
        spans = zip(w.starts[first].tolist(), w.ends[first].tolist())
        sizes, ids = self.words([w.bytes[s:e].decode() for s, e in spans])
        begins = len(self.ids) + np.cumsum(sizes) - sizes
        self.ids = np.concatenate([self.ids, ids])
        self.keys = np.insert(self.keys, at[new], distinct[new])
        self.used = np.insert(self.used, at[new], self.calls)
        self.begins = np.insert(self.begins, at[new], begins)
        self.sizes = np.insert(self.sizes, at[new], sizes)
        at += np.cumsum(new) - new
        self.used[at] = self.calls
        return at

    def _forget(self, needed: np.ndarray) -> None:
        """Keep the half that was used last, and what is needed now."""
        self.used[needed] = self.calls
        stay = self.used >= np.sort(self.used)[-(MEMO // 2) :][:1]
        sizes = self.sizes[stay]
        self.ids = self.ids[_runs(self.begins[stay], sizes)]
        self.keys, self.used, self.sizes = self.keys[stay], self.used[stay], sizes
        self.begins = np.cumsum(sizes) - sizes

    def __call__(self, texts: list[str]) -> list[bytes]:
        w = Words(texts, BLANK)
        distinct, sample, nth = np.unique(w.hashes, return_index=True, return_inverse=True)
        at = self.known(w, distinct, sample)[nth]
        sizes = self.sizes[at]
        data = self.ids[_runs(self.begins[at], sizes)].tobytes()
        bounds = np.concatenate([[0], np.cumsum(sizes)])[w.first].tolist()
        out = [data[4 * a : 4 * b] for a, b in zip(bounds, bounds[1:])]
        for i, t in enumerate(texts):
            if "<" in t and any(s in t for s in self.special):
                out[i] = self.encode([t])[0].tobytes()
        return out


def _runs(begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places of all runs, one after the other."""
    ends = np.cumsum(sizes)
    place = np.arange(int(sizes.sum()), dtype=np.int64)
    place += np.repeat(begins - (ends - sizes), sizes)
    return place


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


class Packer:
    """Windows of pieces; a piece is (document, start, length), a document any handle."""

    def __init__(self, tiers=TIERS):
        self.tiers = tuple(sorted(tiers, reverse=True))
        self.waiting = {t: [] for t in self.tiers}  # (length, document, start), ascending

    def _route(self, doc: int, start: int, length: int) -> None:
        tier = min(t for t in self.tiers if length <= t)
        insort(self.waiting[tier], (length, doc, start))

    def add(self, doc: int, length: int) -> Iterator[list[tuple[int, int, int]]]:
        """Windows that the document fills alone; the rest waits."""
        start, longest = 0, self.tiers[0]
        while length - start >= longest:
            yield [(doc, start, longest)]
            start += longest
        if length - start in self.tiers:
            yield [(doc, start, length - start)]
        elif length > start:
            self._route(doc, start, length - start)

    def _take(self, gap: int) -> tuple[int, int, int] | None:
        """The largest item that fits, or else the front of the shortest one."""
        for tier in self.tiers:
            items = self.waiting[tier]
            if items and items[0][0] <= gap:
                length, doc, start = items.pop(bisect_right(items, (gap, float("inf"))) - 1)
                return doc, start, length
        for tier in reversed(self.tiers):
            if self.waiting[tier]:
                length, doc, start = self.waiting[tier].pop(0)
                self._route(doc, start + gap, length - gap)
                return doc, start, gap
        return None

    def windows(self, last: bool) -> Iterator[list[tuple[int, int, int]]]:
        """Full windows of all tiers; what cannot fill one waits, or is given if ``last``."""
        total = sum(i[0] for items in self.waiting.values() for i in items)
        for tier in self.tiers:
            while self.waiting[tier] and total >= tier:
                length, doc, start = self.waiting[tier].pop()
                window, gap = [(doc, start, length)], tier - length
                while gap:
                    window.append(self._take(gap))
                    gap -= window[-1][2]
                total -= tier
                yield window
        rest = [(d, s, n) for items in self.waiting.values() for n, d, s in items]
        if last and rest:
            self.waiting = {t: [] for t in self.tiers}
            yield rest


def pack(
    docs: DataFrame,
    tokenizer: str,
    tiers=TIERS,
    end: int = END,
    text: str = "text",
    key: str = "doc_id",
    step_tokens: int = STEP_TOKENS,
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset,
    window (size of its sequence), step_group. ``tokenizer`` is the path of a vocabulary file."""
    prepare(docs.sparkSession)
    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    longs = ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "window", "step_group")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, ids, tokens = Packer(tiers), {}, {}
        task = TaskContext.get().partitionId() << 32
        sequence = step = seen = 0
        done: list[list[tuple[int, int, int]]] = []

        def out() -> pa.RecordBatch:
            nonlocal sequence, step, done
            sizes = [sum(p[2] for p in w) for w in done]
            groups = [(0, step + g) for g in range(max(1, round(sum(sizes) / step_tokens)))]
            step += len(groups)
            rows = []
            for w in sorted(range(len(done)), key=lambda w: (-sizes[w], w)):
                load, group = groups[0]
                heapq.heapreplace(groups, (load + sizes[w], group))
                offset = 0
                for doc, start, length in done[w]:
                    crc = zlib.crc32(tokens[doc][4 * start : 4 * (start + length)])
                    n = len(tokens[doc]) // 4
                    rows.append((ids[doc], start, length, crc, n, task | sequence, offset, sizes[w], task | group))
                    offset += length
                sequence += 1
            done = []
            alive = {i[1] for items in packer.waiting.values() for i in items}
            for doc in [d for d in tokens if d not in alive]:
                del tokens[doc], ids[doc]
            columns = list(zip(*rows)) if rows else [[]] * (1 + len(longs))
            return pa.RecordBatch.from_arrays(
                [pa.array(columns[0], id_type), *[pa.array(c, pa.int64()) for c in columns[1:]]],
                ["doc_id", *longs],
            )

        id_type, number, encode, finish = pa.int64(), 0, encoder(tokenizer), end_bytes(end)
        for b in batches:
            id_type = b.schema.field(0).type
            keys, texts = b.column(0).to_pylist(), [t or "" for t in b.column(1).to_pylist()]
            for begin, stop in chunks(texts, CHUNK):
                for doc_id, data in zip(keys[begin:stop], encode(texts[begin:stop])):
                    ids[number], tokens[number] = doc_id, data + finish
                    seen += len(tokens[number]) // 4
                    done.extend(packer.add(number, len(tokens[number]) // 4))
                    number += 1
                if seen >= PORTION:
                    done.extend(packer.windows(last=False))
                    seen = 0
                    yield out()
        done.extend(packer.windows(last=True))
        if done:
            yield out()

    return rows.mapInArrow(tidy(run), f"doc_id {kind}, " + ", ".join(f"{c} long" for c in longs))


def end_bytes(end: int) -> bytes:
    return np.array([end], dtype="<u4").tobytes()
