"""Phrase collocation mining on a weighted de Bruijn graph of words.

Nodes are runs of LONGEST - 1 words and edges the runs of LONGEST words that join two
overlapping nodes; a weight is the number of places where the run stands. Every place of a
text starts one edge, or a shorter run if its piece ends before; these shorter runs are the
corrections by which a node's flow becomes a count: the count of any phrase is the weight of
all edges that begin with it, and of all piece ends that do.

1. A task aggregates the runs of a portion of texts and deals them to buckets by their
   shortest prefix that is not heavy. Heavy prefixes (the language, a very common word or pair)
   are found beforehand: they have more places than a part of a bucket, so at most MOST_HEAVY
   of them exist or are used, and only their names are handed to the tasks.
2. A bucket sums equal runs and derives the counts of all their prefixes, shortest last. What
   begins with a heavy prefix lies in several buckets: each passes on its part of the flow, and
   the parts are summed.
3. A phrase whose whole flow goes through one edge, on its left or its right, is a node of a
   unary path: it is compacted into the longer phrase. As counts never rise with length, one
   word more decides for any longer candidate.
4. What remains is scored by its lowest cut: floor(1000 * a * n / (l * r)) in decimals of 38
   digits. The words of the phrases that can reach the report are then looked up in the texts.

Words are told apart by 64-bit hashes of their lower-cased bytes; runs are compared word by
word. No count, cut or list is bounded but the report itself (``top``).

Defined cases: a null text is empty, a null language is ``und``; repeated rows count as often
as they come; a language without candidates has no rows; ties go by phrase; an empty table
gives an empty result; other columns and doc_id are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import prepare
from plumbline.llm.words import Words, chunks, mix
from plumbline.session import stage

#: Words of an edge, places a candidate needs, phrases reported for each language.
LONGEST, LEAST, TOP = 5, 100, 2000
#: Bytes of text a task aggregates at once, bytes of a place at a guess, places of a bucket.
PORTION, PLACE_BYTES, BUCKET = 6 << 20, 5, 1_500_000
#: A prefix is heavy beyond this part of a bucket; most heavy prefixes that are handed out.
HEAVY_PART, MOST_HEAVY = 4, 1 << 20

SEPARATORS = np.zeros(256, dtype=bool)
SEPARATORS[[0x20, 0x09, *range(0x0A, 0x0E), *b".,;:!?"]] = True
ENDS = SEPARATORS.copy()
ENDS[[0x20, 0x09]] = False

_GROW = np.uint64(0x9E3779B97F4A7C15)


def longer(prefix: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Name of a prefix and one word more."""
    return mix(prefix * _GROW + word)


class Runs:
    """Distinct runs with their weights: columns are the language and up to LONGEST words, as
    places in ``names`` (0: the run has ended)."""

    def __init__(self, names: np.ndarray, columns: np.ndarray, weights: np.ndarray):
        order = self._order(columns, len(names))
        columns, weights = columns[:, order], weights[order]
        new = np.ones(columns.shape[1], dtype=bool)
        new[1:] = (columns[:, 1:] != columns[:, :-1]).any(axis=0)
        self.names, self.columns = names, columns[:, new]
        begins = np.flatnonzero(new)
        self.weights = np.add.reduceat(weights, begins) if len(begins) else weights

    @staticmethod
    def _order(columns: np.ndarray, n: int) -> np.ndarray:
        if n < 1 << 21:  # three places in one number
            keys = columns.astype(np.uint64)
            bits = np.uint64(21)
            high = (((keys[0] << bits) | keys[1]) << bits) | keys[2]
            low = (((keys[3] << bits) | keys[4]) << bits) | keys[5]
            return np.lexsort((low, high))
        return np.lexsort(columns[::-1])

    def prefixes(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For each length from 0: names of all runs' prefixes, and which runs are that long."""
        name = self.names[self.columns[0]]
        yield 0, name, np.ones(len(name), dtype=bool)
        for k in range(1, LONGEST + 1):
            name = longer(name, self.names[self.columns[k]])
            yield k, name, self.columns[k] > 0


def _member(sorted_names: np.ndarray, names: np.ndarray) -> np.ndarray:
    if not len(sorted_names):
        return np.zeros(len(names), dtype=bool)
    return sorted_names[np.searchsorted(sorted_names, names).clip(0, len(sorted_names) - 1)] == names


def _portions(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, list[str]]]:
    for b in batches:
        langs, texts = b.column(0).to_numpy().view(np.uint64), [t or "" for t in b.column(1).to_pylist()]
        for begin, end in chunks(texts, PORTION):
            yield langs[begin:end], texts[begin:end]


def runs_of(langs: np.ndarray, texts: list[str]) -> Runs:
    """Runs that start at the words of ``texts``; ``langs`` names each text's language."""
    w = Words(texts, SEPARATORS)
    ends = np.cumsum(ENDS[np.frombuffer(w.bytes, dtype=np.uint8)], dtype=np.int32)
    piece = ends[w.starts]
    names, nth = np.unique(np.concatenate([w.hashes, langs]), return_inverse=True)
    n = len(w.hashes)
    columns = np.zeros((LONGEST + 1, n), dtype=np.int32)
    columns[0] = np.repeat(nth[n:], np.diff(w.first)) + 1
    for k in range(LONGEST):
        columns[k + 1, : n - k] = np.where(piece[k:] == piece[: n - k], nth[k:n] + 1, 0) if n > k else 0
    return Runs(np.concatenate([np.zeros(1, np.uint64), names]), columns, np.ones(n, dtype=np.int64))


def _heavy(share: float):
    """Prefixes that have at least this share of a portion's places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for langs, texts in _portions(batches):
            runs = runs_of(langs, texts)
            least = share * runs.weights.sum()
            names, counts = [], []
            some = np.arange(len(runs.weights))
            for k, name, long in runs.prefixes():
                if k == LONGEST:
                    break
                # Only what begins with a frequent prefix can be a frequent longer one.
                some = some[long[some]]
                values, nth = np.unique(name[some], return_inverse=True)
                sums = np.bincount(nth, runs.weights[some], len(values)).astype(np.int64)
                often = sums >= max(1, least)
                names.append(values[often])
                counts.append(sums[often])
                some = some[often[nth]]
            names, counts = np.concatenate(names), np.concatenate(counts)
            yield pa.RecordBatch.from_arrays([pa.array(names.view(np.int64)), pa.array(counts)], ["prefix", "places"])

    return run


_DEALT = "bucket int, names binary, columns binary, wide boolean, weights binary"


def _deal(heavy: np.ndarray, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for langs, texts in _portions(batches):
            runs = runs_of(langs, texts)
            route, open_ = np.zeros(len(runs.weights), dtype=np.uint64), np.ones(len(runs.weights), dtype=bool)
            for k, name, long in runs.prefixes():
                open_ &= long
                route[open_] = name[open_]
                open_ &= _member(heavy, name) | (k == 0)
            to = (route >> np.uint64(16)) % np.uint64(buckets)
            order = np.argsort(to, kind="stable")
            cuts = np.searchsorted(to[order], np.arange(buckets + 1))
            rows = []
            for bucket, (a, b) in enumerate(zip(cuts, cuts[1:])):
                if b > a:
                    at = order[a:b]
                    columns = runs.columns[:, at]
                    used, nth = np.unique(columns, return_inverse=True)
                    if used[0] != 0:
                        used, nth = np.concatenate([[0], used]), nth + 1
                    wide = len(used) > 1 << 16
                    nth = nth.reshape(columns.shape).astype(np.uint32 if wide else np.uint16)
                    weights = runs.weights[at].astype(np.uint32)
                    rows.append((bucket, runs.names[used[1:]].tobytes(), nth.tobytes(), wide, weights.tobytes()))
            columns = list(zip(*rows)) or [[]] * 5
            types = [pa.int32(), pa.binary(), pa.binary(), pa.bool_(), pa.binary()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, types)], ["bucket", "names", "columns", "wide", "weights"]
            )

    return run


_COUNTS = "lang long, words array<long>, places long"


def _count(heavy: np.ndarray):
    """Counts of a bucket's phrases: those it holds alone and that reach LEAST, and the flow of heavy prefixes."""

    def run(group: pa.Table) -> pa.Table:
        records = [group.column(c).to_pylist() for c in ("names", "columns", "wide", "weights")]
        every = [np.frombuffer(n, dtype=np.uint64) for n in records[0]]
        names = np.concatenate([np.zeros(1, np.uint64), np.unique(np.concatenate(every))])
        columns = []
        for own, data, wide in zip(every, records[1], records[2]):
            to = np.concatenate([[0], np.searchsorted(names[1:], own) + 1]).astype(np.int32)
            columns.append(to[np.frombuffer(data, dtype=np.uint32 if wide else np.uint16).reshape(LONGEST + 1, -1)])
        weights = np.concatenate([np.frombuffer(w, dtype=np.uint32) for w in records[3]]).astype(np.int64)
        runs = Runs(names, np.concatenate(columns, axis=1), weights)
        del columns, weights, records, every
        out_langs, out_words, out_sizes, out_places = [], [], [], []
        new = np.zeros(len(runs.weights), dtype=bool)
        new[0] = True
        for k, name, long in runs.prefixes():
            new[1:] |= runs.columns[k][1:] != runs.columns[k][:-1]
            begins = np.flatnonzero(new)
            places = np.add.reduceat(runs.weights, begins)
            passed = (_member(heavy, name[begins]) & (k < LONGEST)) | (k == 0)
            keep = long[begins] & (passed | (places >= LEAST))
            at = begins[keep]
            out_langs.append(names[runs.columns[0][at]])
            out_words.append(names[runs.columns[1 : k + 1][:, at]].T.ravel())
            out_sizes.append(np.full(len(at), k))
            out_places.append(places[keep])
        sizes = np.concatenate(out_sizes)
        bounds = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
        words = pa.array(np.concatenate(out_words).view(np.int64))
        return pa.table(
            {
                "lang": pa.array(np.concatenate(out_langs).view(np.int64)),
                "words": pa.ListArray.from_arrays(bounds, words),
                "places": pa.array(np.concatenate(out_places)),
            }
        )

    return run


def _texts_of_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for _, texts in _portions(batches):
        w = Words(texts, SEPARATORS)
        names, at = np.unique(w.hashes, return_index=True)
        words = [w.bytes[s:e].lower().decode() for s, e in zip(w.starts[at].tolist(), w.ends[at].tolist())]
        yield pa.RecordBatch.from_arrays([pa.array(names.view(np.int64)), pa.array(words, pa.string())], ["word", "spelt"])


def _phrases(rows: DataFrame) -> DataFrame:
    """lang, words, places of every phrase with LEAST places, and of every language (no words)."""
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    places = max(1, size // PLACE_BYTES)
    buckets = -(-places // BUCKET)
    heavy = np.empty(0, dtype=np.uint64)
    if buckets > 1:
        # Summing only what a portion holds often enough loses less than half of a heavy prefix.
        share = max(BUCKET / (2 * HEAVY_PART * places), 1 / MOST_HEAVY)
        found = rows.mapInArrow(_heavy(share), "prefix long, places long").groupBy("prefix").agg(F.sum("places").alias("places"))
        found = found.where(F.col("places") >= share * places / 2).orderBy(F.desc("places"), "prefix").limit(MOST_HEAVY)
        heavy = np.sort(np.array([r[0] for r in found.select("prefix").collect()], dtype=np.int64).view(np.uint64))
    dealt = rows.mapInArrow(_deal(heavy, buckets), _DEALT)
    counts = dealt.groupBy("bucket").applyInArrow(_count(heavy), _COUNTS)
    counts = counts.groupBy("lang", "words").agg(F.sum("places").alias("places"))
    return counts.where((F.col("places") >= LEAST) | (F.size("words") == 0))


def mine(docs: DataFrame, text: str = "text", lang: str = "lang", top: int = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of each language's best phrases."""
    prepare(docs.sparkSession)
    tongue = F.coalesce(F.col(lang).cast("string"), F.lit("und"))
    rows = docs.select(F.xxhash64(tongue).alias("lang"), F.col(text).alias("text"))
    counts = stage(_phrases(rows), "phrase_counts")
    total = counts.where(F.size("words") == 0).select("lang", F.col("places").alias("n"))
    known = counts.where(F.size("words") > 0)
    several = known.where(F.size("words") > 1).withColumnRenamed("places", "a")
    # Unary nodes: an edge on one side carries the whole flow.
    inner = known.where(F.size("words") > 2)
    left = F.slice("words", 1, F.size("words") - 1)
    right = F.slice("words", 2, F.size("words") - 1)
    flows = inner.select("lang", F.explode(F.array(left, right)).alias("words"), "places")
    most = flows.groupBy("lang", "words").agg(F.max("places").alias("most"))
    kept = several.join(most, ["lang", "words"], "left").where(F.col("most").isNull() | (F.col("most") < F.col("a")))
    cuts = kept.select("lang", "words", "a", F.explode(F.sequence(F.lit(1), F.size("words") - 1)).alias("k"))
    cuts = cuts.withColumn("first", F.slice("words", 1, F.col("k"))).withColumn(
        "rest", F.slice("words", F.col("k") + 1, F.size("words") - F.col("k"))
    )
    part = lambda name, value: known.select("lang", F.col("words").alias(name), F.col("places").alias(value))
    cuts = cuts.join(part("first", "l"), ["lang", "first"]).join(part("rest", "r"), ["lang", "rest"]).join(total, "lang")
    exact = lambda c: f"cast({c} as decimal(38, 0))"
    score = F.expr(f"cast({exact('a')} * {exact('n')} * {exact('1000')} div ({exact('l')} * {exact('r')}) as bigint)")
    cuts = cuts.select("lang", "words", "a", "n", F.struct(score.alias("score"), "k", "l", "r").alias("cut"))
    best = cuts.groupBy("lang", "words", "a", "n").agg(F.min("cut").alias("cut"))
    best = best.select("lang", "words", "a", "n", "cut.l", "cut.r", "cut.score")
    # With all ties of the last place, until the phrases are spelt.
    order = [F.desc("score"), F.desc("a")]
    place = F.rank().over(Window.partitionBy("lang").orderBy(*order))
    best = stage(best.withColumn("place", place).where(F.col("place") <= top).drop("place"), "phrase_best")
    needed = stage(best.select(F.explode("words").alias("word")).distinct(), "phrase_words")
    spelt = rows.mapInArrow(_texts_of_words, "word long, spelt string").join(needed, "word")
    spelt = spelt.groupBy("word").agg(F.min("spelt").alias("spelt"))
    words = best.select("lang", "words", F.posexplode("words").alias("at", "word")).join(spelt, "word")
    listed = F.array_sort(F.collect_list(F.struct("at", "spelt")))["spelt"]
    phrases = words.groupBy("lang", "words").agg(F.array_join(listed, " ").alias("phrase"))
    tongues = docs.select(F.xxhash64(tongue).alias("lang"), tongue.alias("tongue")).distinct()
    done = best.join(phrases, ["lang", "words"]).join(tongues, "lang")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(*order, "phrase"))
    done = done.withColumn("rank", rank.cast("long")).where(F.col("rank") <= top)
    return done.select(F.col("tongue").alias("lang"), "rank", "phrase", "a", "l", "r", "n", "score")
