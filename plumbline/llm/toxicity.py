"""Toxicity: a weighted lexicon, matched by Aho-Corasick on folded text.

Text is lower-cased, look-alike letters of other scripts and digits put for letters are
folded, and everything but letters becomes one blank. Terms are beginnings of words or
whole words with a weight. What matches inside an exception phrase does not count. The
sum of weights and the sum per word (normalised by length) give the score through a
logistic curve.

Terms and weights are learned from labelled texts: a term's weight is the log ratio of
the shares of toxic and of clean documents that have it. So are single-word exceptions:
words under a term that clean documents have as often. At most ``FIT_ROWS`` rows per class
(in expectation, chosen by hash) are used for the fit, two thirds of them for the lexicon
and one for the curve; scoring covers every text whole.

Defined cases: a null or empty text has no hits and gets the score of those; rows without
a label or a doc_id are scored and not learned from; repeated rows get equal scores; with
no toxic or no clean labels nothing is learned and every score is 0; empty tables give
empty results; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import prepare, tidy
from plumbline.session import stage

#: Labelled rows of each class that the fit uses, in expectation.
FIT_ROWS = 12_000
#: Lengths of word beginnings that may become terms; whole words of more letters than LEAST may, too.
STEMS, LEAST, LONGEST = (3, 4, 5, 6, 7, 8), 2, 24
#: A term is in so many toxic fit rows at least, with this weight and this log likelihood ratio
#: against having no meaning; chance alone gives ten thousands of terms a ratio of 9. Terms at most.
MIN_ROWS, MIN_WEIGHT, MIN_EVIDENCE, MOST_TERMS = 3, 1.6, 11.0, 2000
#: Terms that a task counts before it passes the counts on.
PORTION = 200_000
#: Score from which a text is rejected.
THRESHOLD = 0.7

# Letters of other scripts that look like Latin ones, and digits and signs put for letters.
LOOKALIKES = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "ё": "e", "һ": "h", "і": "i", "ї": "i", "ј": "j",
    "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "ѕ": "s", "т": "t", "у": "y", "х": "x",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t",
    "υ": "u", "χ": "x", "ɡ": "g", "ı": "i", "ⅼ": "l",
}
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s"}
INVISIBLE = "­​‌‍⁠﻿"
#: Phrases in which a term is no insult.
EXCEPTIONS = ("trash can", "trash bin", "trash collection", "clown fish", "worthless check", "class clown")

_FOLD = {
    **{ord(k): v for k, v in {**LOOKALIKES, **SUBSTITUTES}.items()},
    **{ord(c): None for c in INVISIBLE},
    **{c: chr(c - 0xFEE0) for c in range(0xFF21, 0xFF5B)},  # full-width letters
}
_WORD = re.compile(r"[^\W\d_]+")


def fold(text: str) -> list[str]:
    """Folded words."""
    return _WORD.findall(text.lower().translate(_FOLD).lower())


def held_out(key: Column) -> Column:
    return F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(3)) == 1


def _terms_of(words: Iterable[str]) -> set[str]:
    """A blank stands for the edge of a word."""
    out = set()
    for w in set(words):
        for n in STEMS:
            if len(w) >= n:
                out.add(" " + w[:n])
        if LEAST < len(w) <= LONGEST:
            out.add(f" {w} ")
    return out


def _count_terms(fit: DataFrame) -> DataFrame:
    """Toxic and clean documents with each term; a task adds up its rows first."""

    def added_up(counts: tuple[Counter, Counter]) -> pa.RecordBatch:
        terms = list(counts[0].keys() | counts[1].keys())
        return pa.RecordBatch.from_arrays(
            [
                pa.array(terms, pa.string()),
                pa.array([counts[1][t] for t in terms], pa.int64()),
                pa.array([counts[0][t] for t in terms], pa.int64()),
            ],
            ["term", "toxic", "clean"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = (Counter(), Counter())
        for b in batches:
            for text, toxic in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                counts[toxic].update(_terms_of(fold(text or "")))
                if len(counts[0]) + len(counts[1]) > PORTION:
                    yield added_up(counts)
                    counts = (Counter(), Counter())
        yield added_up(counts)

    counted = fit.select("text", "toxic").mapInArrow(run, "term string, toxic long, clean long")
    return counted.groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


class Lexicon:
    """Terms with weights, exception phrases, and the curve; small enough to go to every task."""

    def __init__(self, terms: dict[str, float], exceptions: Iterable[str], curve=(0.0, 0.0, 0.0)):
        self.terms, self.curve = terms, curve
        self.exceptions = sorted(exceptions)
        self._matcher = None

    def __getstate__(self):
        return {**self.__dict__, "_matcher": None}

    def _automaton(self):
        if self._matcher is None:
            import ahocorasick

            self._matcher = ahocorasick.Automaton()
            for term, weight in self.terms.items():
                self._matcher.add_word(term, (term, weight))
            for phrase in self.exceptions:
                self._matcher.add_word(f" {phrase} ", (f" {phrase} ", None))
            self._matcher.make_automaton()
        return self._matcher

    def match(self, text: str | None) -> tuple[float, int, int]:
        """Sum of weights, hits and words of a text."""
        words = fold(text or "")
        if not self.terms or not words:
            return 0.0, 0, len(words)
        hits, spared = [], []
        for last, (term, weight) in self._automaton().iter(f" {' '.join(words)} "):
            span = (last - len(term) + 1, last)
            (spared if weight is None else hits).append((*span, weight))
        kept = [h for h in hits if not any(s[0] <= h[0] and h[1] <= s[1] for s in spared)] if spared else hits
        return sum(h[2] for h in kept), len(kept), len(words)

    @staticmethod
    def features(found: np.ndarray) -> np.ndarray:
        total, _, words = found.T
        return np.column_stack([np.ones(len(found)), np.log1p(total), np.log1p(100 * total / np.maximum(words, 1))])

    def score(self, found: np.ndarray) -> np.ndarray:
        if not self.terms:
            return np.zeros(len(found))
        return 1 / (1 + np.exp(-np.clip(self.features(found) @ np.asarray(self.curve), -50, 50)))


def _fit_curve(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-2) -> tuple[float, ...]:
    """Logistic regression by Newton steps on a few features."""
    beta = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -50, 50)))
        w = weight * p * (1 - p)
        step = np.linalg.solve((x.T * w) @ x + ridge * np.eye(len(beta)), x.T @ (weight * (y - p)) - ridge * beta)
        beta = beta + step
        if np.abs(step).max() < 1e-8:
            break
    return tuple(beta.tolist())


def fit_sample(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> tuple[DataFrame, dict[int, int]]:
    """Texts with their labels for the fit, and how many labels each class has.

    Labels of held-out documents are not used; of several labels of a document the largest
    counts. Rows are drawn from the labels alone, so that the table that meets the texts
    has no more than ``fit_rows`` rows a class and can go to every task.
    """
    own = labels.where(F.col("toxic").isin(0, 1) & ~held_out(F.col("doc_id")))
    own = own.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    sizes = {r["toxic"]: r["n"] for r in own.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    draw = F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(1_000_000)) / F.lit(1e6)
    rate = F.when(F.col("toxic") == 1, fit_rows / sizes.get(1, 1)).otherwise(fit_rows / sizes.get(0, 1))
    part = (F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(3)) == 0).cast("int")
    drawn = own.where(draw < rate).withColumn("part", part)
    used = docs.select("doc_id", "text").join(F.broadcast(drawn), "doc_id")
    used = used.dropDuplicates(["text", "toxic"])  # copies are no further evidence
    return stage(used.select("text", "toxic", "part"), "toxic_fit"), sizes


def fit(
    docs: DataFrame, labels: DataFrame, exceptions: Iterable[str] = EXCEPTIONS, fit_rows: int = FIT_ROWS
) -> Lexicon:
    """Learns from ``docs`` (doc_id, text) and ``labels`` (doc_id, toxic: 0 or 1)."""
    prepare(docs.sparkSession)
    used, sizes = fit_sample(docs, labels, fit_rows)
    counts = _count_terms(used.where("part = 0"))
    have = {r["toxic"]: r["n"] for r in used.where("part = 0").groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if len(have) < 2:
        return Lexicon({}, exceptions)
    share = lambda c, n: (F.col(c) + 0.5) / F.lit(n + 1.0)
    counts = stage(counts.withColumn("weight", F.log(share("toxic", have[1]) / share("clean", have[0]))), "toxic_terms")
    either = (F.col("toxic") + F.col("clean")) / F.lit(have[0] + have[1])
    evidence = F.col("toxic") * F.log(F.col("toxic") / have[1] / either)
    good = counts.where((F.col("toxic") >= MIN_ROWS) & (F.col("weight") >= MIN_WEIGHT) & (evidence >= MIN_EVIDENCE))
    ranked = good.orderBy(F.desc(evidence), F.length("term"), "term").limit(MOST_TERMS)
    terms: dict[str, float] = {}
    for r in ranked.collect():
        t = r["term"]
        if not any(t.startswith(o) or o.startswith(t) for o in terms):
            terms[t] = r["weight"]
    if not terms:
        return Lexicon({}, exceptions)
    # Whole words under a term that clean documents have as readily.
    under = F.substring("term", 1, 4).isin(sorted({t[:4] for t in terms}))
    words = counts.where(under & F.col("term").endswith(" ") & (F.col("clean") >= MIN_ROWS) & (F.col("weight") <= 0))
    own = [r["term"].strip() for r in words.orderBy(F.desc("clean"), "term").limit(MOST_TERMS).collect()]
    own = [w for w in own if any(f" {w} ".startswith(t) for t in terms)]
    lexicon = Lexicon(terms, {*exceptions, *own})
    fitted = matched(used.where("part = 1"), lexicon, ["toxic"]).toPandas()  # numbers of FIT_ROWS rows a class
    if fitted["toxic"].nunique() < 2:
        return Lexicon({}, exceptions)
    y = fitted["toxic"].to_numpy()
    n = np.bincount(y)
    weight = np.where(y == 1, sizes[1] / n[1], sizes[0] / n[0]) / (sum(sizes.values()) / len(y))
    found = fitted[["total", "hits", "words"]].to_numpy(float)
    lexicon.curve = _fit_curve(lexicon.features(found), y, weight)
    return lexicon


def matched(rows: DataFrame, lexicon: Lexicon, keep: list[str], text: str = "text") -> DataFrame:
    """The columns ``keep`` with total, hits, words and score of each row's text."""
    picked = rows.select(*keep, F.col(text).alias("_matched"))
    kinds = [f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = np.array([lexicon.match(t) for t in b.column(b.num_columns - 1).to_pylist()], float).reshape(-1, 3)
            yield pa.RecordBatch.from_arrays(
                [
                    *b.columns[:-1],
                    pa.array(found[:, 0]),
                    pa.array(found[:, 1].astype(np.int64)),
                    pa.array(found[:, 2].astype(np.int64)),
                    pa.array(lexicon.score(found)),
                ],
                [*keep, "total", "hits", "words", "score"],
            )

    return picked.mapInArrow(run, ", ".join([*kinds, "total double", "hits long", "words long", "score double"]))


def without_toxic(docs: DataFrame, lexicon: Lexicon, threshold: float = THRESHOLD, text: str = "text") -> DataFrame:
    """The rows of ``docs`` with a score under ``threshold``, all columns as they are."""
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = np.array([lexicon.match(t) for t in b.column(text).to_pylist()], float).reshape(-1, 3)
            yield b.filter(pa.array(lexicon.score(found) < threshold))

    return docs.mapInArrow(tidy(run), docs.schema)


def score(docs: DataFrame, lexicon: Lexicon, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, score, hits and words of every row."""
    prepare(docs.sparkSession)
    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    return matched(rows, lexicon, ["doc_id"]).select("doc_id", "score", "hits", "words")
