"""Words of many texts at once, as 64-bit hashes, and hashes of word shingles.

Everything is numpy over the UTF-8 bytes of a few megabytes of text, so that a task
needs memory for that much, and for one longest text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Words of a shingle.
SHINGLE = 5
#: Bytes of text hashed at once, and bytes of a piece with its own powers.
CHUNK, PIECE = 4 << 20, 1 << 18

_STEP = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer of SplitMix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    p = np.full(n, base, dtype=np.uint64)
    p[0] = 1
    return np.cumprod(p)


_BASE = 0xD1342543DE82EF95
_UNBASE = pow(_BASE, -1, 1 << 64)
_tables: dict[str, np.ndarray] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_tables.get("up", ())) < n:
        _tables.update(up=_powers(_BASE, n), down=_powers(_UNBASE, n))
    return _tables["up"], _tables["down"]


_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * _STEP)
_VALUES[65:91] = _VALUES[97:123]  # A-Z count as a-z

_SHIFT = mix(np.arange(1, SHINGLE + 1, dtype=np.uint64) * _STEP) | np.uint64(1)

SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
BLANK = np.zeros(256, dtype=bool)
BLANK[[0x20, 0x0A]] = True
#: Everything of ASCII but digits and letters.
NON_WORD = np.ones(256, dtype=bool)
NON_WORD[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False


def chunks(texts: list[str], limit: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges of ``texts`` of about ``limit`` characters, of one text at least."""
    begin = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > limit:
            yield begin, i
            begin, size = i, 0
        size += len(t) + 1
    if begin < len(texts):
        yield begin, len(texts)


class Words:
    """Words of texts: bytes of all texts, starts, ends and hashes of the words, and where
    each text's words begin among them (``first``, one more than texts)."""

    def __init__(self, texts: list[str], separators: np.ndarray):
        raw = [t.encode() for t in texts]
        self.bytes = b"\n".join(raw) + b"\n"
        data = np.frombuffer(self.bytes, dtype=np.uint8)
        apart = separators[data]
        edge = np.empty(len(data), dtype=bool)
        edge[0] = not apart[0]
        np.not_equal(apart[1:], apart[:-1], out=edge[1:])
        at = np.flatnonzero(edge)
        self.starts, self.ends = at[::2], at[1::2]
        self.hashes = np.empty(len(self.starts), dtype=np.uint64)
        i = 0
        while i < len(self.starts):
            low = self.starts[i]
            j = max(i + 1, int(np.searchsorted(self.ends, low + PIECE, "right")))
            piece = _VALUES[data[low : self.ends[j - 1]]]
            up, down = _power_tables(max(PIECE, len(piece)))
            total = np.cumsum(piece * up[: len(piece)])
            s, e = self.starts[i:j] - low, self.ends[i:j] - low
            before = np.where(s > 0, total[s - 1], np.uint64(0))
            self.hashes[i:j] = mix((total[e - 1] - before) * down[s])
            i = j
        begins = np.zeros(len(texts) + 1, dtype=np.int64)
        np.cumsum([len(r) + 1 for r in raw], out=begins[1:])
        self.first = np.searchsorted(self.starts, begins)


def word_hashes(texts: list[str], separators: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray]:
    w = Words(texts, separators)
    return w.hashes, w.first


def shingle_sets(texts: list[str | None], size: int = SHINGLE) -> Iterator[np.ndarray]:
    """For each text its distinct hashes of shingles of ``size`` words (SHINGLE at most), ascending.

    Lower-cased (A-Z) words between ASCII white space; a text with fewer words than a
    shingle has them all as its one shingle, and without words it has none.
    """
    texts = [t or "" for t in texts]
    for begin, end in chunks(texts):
        w, first = word_hashes(texts[begin:end])
        n = max(0, len(w) - size + 1)
        s = np.zeros(n, dtype=np.uint64)
        for k in range(size):
            s += w[k : k + n] * _SHIFT[k]
        s = mix(s)
        for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
            if b - a >= size:
                yield np.unique(s[a : b - size + 1])
            elif b > a:
                yield mix((w[a:b] * _SHIFT[: b - a]).sum(keepdims=True) + np.uint64(b - a))
            else:
                yield np.empty(0, dtype=np.uint64)
