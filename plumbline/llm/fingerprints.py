"""Document fingerprints: bottom-k sketches of shingle hashes.

A sketch holds the ``k`` smallest distinct hashes of a document's word shingles. The
sketch of a union is the ``k`` smallest of the parts' sketches, so parts of a document
or whole groups of documents merge. From sketches follow resemblance, containment and
the number of distinct shingles; with at most ``k`` shingles these are exact.

Defined cases: a null or empty text has an empty sketch; two empty sketches resemble
each other fully, an empty one and another not at all; equal texts have equal sketches;
texts shorter than a shingle have one hash; repeated rows get equal results; empty
tables give empty results; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import prepare
from plumbline.llm.words import shingle_sets

#: Hashes of a sketch, and their bits. 48 bits keep a sketch short and still tell 10**12 shingles apart.
K, BITS = 256, 48
#: Rows of a range of documents on average, and ranges at most.
RANGE_ROWS, MOST_RANGES = 4096, 65_536


def sketches(texts: list[str | None], k: int = K) -> Iterator[np.ndarray]:
    for s in shingle_sets(texts):
        yield s[:k] >> np.uint64(64 - BITS)


def encode(sketch: np.ndarray) -> str:
    """Base64 of the hashes, ascending, six bytes each."""
    return base64.b64encode(sketch.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 2:].tobytes()).decode()


def likeness(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated resemblance: the share of the union's ``k`` smallest that both have."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    both = np.concatenate([a, b])
    both.sort()
    same = both[1:][both[1:] == both[:-1]]
    union = len(both) - len(same)
    if union <= k:
        return len(same) / union
    keep = np.ones(len(both), dtype=bool)
    np.not_equal(both[1:], both[:-1], out=keep[1:])
    last = both[keep][k - 1]
    return int(np.searchsorted(same, last, "right")) / k


def fingerprint(docs: DataFrame, text: str = "text", key: str = "doc_id", k: int = K) -> DataFrame:
    """doc_id and ``sketch``, an ascending array of longs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [s.astype(np.int64) for s in sketches(b.column(1).to_pylist(), k)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(found, pa.list_(pa.int64()))], ["doc_id", "sketch"]
            )

    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, sketch array<long>")


def merge(sketched: DataFrame, by: str, k: int = K) -> DataFrame:
    """The sketch of all documents with one value of ``by``: a hot value is reduced to ``k``
    rows by every task before the shuffle."""
    each = sketched.select(by, F.explode("sketch").alias("_h")).groupBy(by, "_h").agg(F.lit(1).alias("_one"))
    ranked = each.withColumn("_n", F.row_number().over(Window.partitionBy(by).orderBy("_h")))
    return ranked.where(F.col("_n") <= k).groupBy(by).agg(F.sort_array(F.collect_list("_h")).alias("sketch"))


def _union(a: Column, b: Column, k: int) -> Column:
    return F.slice(F.array_sort(F.array_union(a, b)), 1, k)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    u = _union(a, b, k)
    shared = F.size(F.array_intersect(F.array_intersect(a, b), u))
    return F.when(F.size(u) == 0, F.lit(1.0)).otherwise(shared / F.size(u))


def distinct_shingles(sketch: Column, k: int = K) -> Column:
    """(k - 1) over the k-th smallest hash as a fraction of the range; exact below ``k``."""
    full = F.lit(k - 1) * F.lit(float(2**BITS)) / F.element_at(sketch, -1)
    return F.when(F.size(sketch) < k, F.size(sketch).cast("double")).otherwise(full)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of ``a``'s shingles that ``b`` has too."""
    union = distinct_shingles(_union(a, b, k), k)
    share = resemblance(a, b, k) * union / distinct_shingles(a, k)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), share))


def _in_order(docs: DataFrame) -> DataFrame:
    """Rows in descending doc_id, dealt in ranges, each followed by the first of the next range.

    Rows of one id, or of none, follow each other by a hash of their text. Ranges begin at rows
    chosen by a hash of id and text, so a range's first row is known beforehand and is sent to
    the range before it as well; many rows of one id make many ranges. The last range is
    followed by the first.
    """
    # Falls from row to row: a missing id is the smallest, and text hashes rise.
    docs = docs.withColumn("place", F.struct("doc_id", F.bitwise_not(F.xxhash64("text")).alias("turn")))
    n = docs.count()
    every = max(RANGE_ROWS, n // MOST_RANGES)
    chosen = docs.where(F.pmod(F.xxhash64("doc_id", "place.turn"), F.lit(every)) == 0)
    heads = (
        chosen.select("place")
        .unionAll(docs.agg(F.max("place").alias("place")))
        .agg(F.sort_array(F.collect_set("place"), asc=False).alias("heads"))
    )
    placed = docs.withColumn("heads", heads.scalar())
    steps = F.array(*[F.lit(2**p) for p in range((n // every * 2 + MOST_RANGES).bit_length(), -1, -1)])
    # The last head that is not below the document.
    before = F.aggregate(
        steps,
        F.lit(0),
        lambda at, step: F.when(F.get("heads", at + step - 1) >= F.col("place"), at + step).otherwise(at),
    )
    count = F.size("heads")
    placed = placed.withColumn("range", F.greatest(before - 1, F.lit(0)))
    is_head = F.get("heads", F.col("range")) == F.col("place")
    own = F.struct(F.col("range").alias("range"), F.lit(False).alias("guest"))
    ahead = F.struct(F.pmod(F.col("range") - 1, F.greatest(count, F.lit(1))).alias("range"), F.lit(True).alias("guest"))
    to = F.when(is_head, F.array(own, ahead)).otherwise(F.array(own))
    return (
        placed.select("doc_id", "text", F.inline(to))
        .repartition("range")
        .sortWithinPartitions("range", "guest", F.desc_nulls_last("doc_id"), F.xxhash64("text"))
        .select("doc_id", "text", "range", "guest")
    )


def edited(text: str, following: str) -> str:
    """The last third of ``text`` replaced by the first as many characters of ``following``."""
    m = len(text) // 3
    return text[: len(text) - m] + following[:m]


def compare_with_edits(docs: DataFrame, text: str = "text", key: str = "doc_id", k: int = K) -> DataFrame:
    """Fingerprints of every document and of its text as edited from the next document.

    The next document is the one with the next smaller doc_id, and the first follows the
    last. Rows with equal ids follow each other in the order of a text hash; a null id
    comes last.
    """
    prepare(docs.sparkSession)
    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    columns = [
        f"doc_id {kind}",
        "n_chars long",
        "edited_sha256 string",
        "fingerprint string",
        "edited_fingerprint string",
        "near_edited double",
        "near_next double",
    ]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the last row waits for the one after it
        for b in batches:
            ids, texts, ranges, guests = (c.to_pylist() for c in b.columns)
            texts = [t or "" for t in texts]
            own = list(sketches(texts, k))
            if held:
                ids, texts, ranges, guests, own = ([h, *x] for h, x in zip(held, (ids, texts, ranges, guests, own)))
            held = (ids[-1], texts[-1], ranges[-1], guests[-1], own[-1])
            pairs = [i for i in range(len(ids) - 1) if not guests[i] and ranges[i] == ranges[i + 1]]
            changed = [edited(texts[i], texts[i + 1]) for i in pairs]
            others = list(sketches(changed, k))
            if pairs:
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([ids[i] for i in pairs], b.schema.field(0).type),
                        pa.array([len(texts[i]) for i in pairs], pa.int64()),
                        pa.array([hashlib.sha256(t.encode()).hexdigest() for t in changed]),
                        pa.array([encode(own[i]) for i in pairs]),
                        pa.array([encode(s) for s in others]),
                        pa.array([likeness(own[i], s, k) for i, s in zip(pairs, others)]),
                        pa.array([likeness(own[i], own[i + 1], k) for i in pairs]),
                    ],
                    [c.split()[0] for c in columns],
                )

    return _in_order(rows).mapInArrow(run, ", ".join(columns))
