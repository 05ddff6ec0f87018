"""Sharding: minimax contiguous partition of atomic groups.

Groups of equal texts are laid out in the order of a 64-bit digest of the text. The
smallest capacity for which a greedy left-to-right cut needs no more than the given
number of shards is found by binary search, and the cuts are made under it.

The driver never sees the groups. It sees sums over ranges of digests ("cells", a
bounded number), and only the cells in which a cut can fall, or which are larger than
the bound, are looked at again in finer ranges, down to single groups.

Defined cases: a null text counts as empty, so it is in the group of empty texts; rows
with a null ``doc_id`` and repeated rows are rows like others (each has a slot of its
own); an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import prepare
from plumbline.session import stage

#: Cells of the first look: 2**FIRST_BITS. A closer look splits a cell into 2**MORE_BITS.
FIRST_BITS, MORE_BITS = 14, 10
#: Rows numbered in one window, and windows for each shard, at most.
UNIT_ROWS, MOST_UNITS = 10_000, 65_536
#: Added to the bytes of every text.
ROW_BYTES = 8


def _cell(digest, bits: int):
    return F.shiftleft(F.shiftright(digest, 64 - bits), 64 - bits) if bits < 64 else digest


class _Line:
    """Atoms in digest order; an atom is a cell of ``bits`` bits, or a group (64 bits)."""

    def __init__(self, start, total, bits):
        order = np.argsort(start)
        self.start, self.total, self.bits = start[order], total[order], bits[order]
        self.end = np.cumsum(self.total)

    def before(self, atom: int) -> int:
        return int(self.end[atom - 1]) if atom else 0

    def greedy(self, capacity: int, shards: int, atom: int = 0) -> list[int]:
        """First atoms of the shards that follow the one at ``atom``, or as many as fit in ``shards``."""
        cuts = []
        while atom < len(self.end) and len(cuts) < shards:
            atom = int(np.searchsorted(self.end, self.before(atom) + capacity, "right"))
            cuts.append(atom)
        return cuts

    def fits(self, capacity: int, shards: int, atom: int = 0) -> bool:
        if atom >= len(self.end):
            return True
        if shards <= 0 or int(self.total[atom:].max()) > capacity:
            return False
        return self.greedy(capacity, shards, atom)[-1] >= len(self.end)

    def smallest(self, shards: int, low: int) -> int:
        low = max(low, int(self.total.max()))
        high = low + int(self.total.max()) + 1
        while low < high:
            mid = (low + high) // 2
            low, high = (low, mid) if self.fits(mid, shards) else (mid + 1, high)
        return low


def minimax_cuts(groups: DataFrame, shards: int) -> tuple[list[int], int]:
    """Digests at which shards 1, 2, ... begin, and the smallest feasible capacity.

    ``groups`` has one row per group: ``digest`` (long) and ``bytes`` (long).
    """

    def look(bits, within=None, cells=()):
        rows = groups if within is None else groups.where(_cell(F.col("digest"), within).isin(cells))
        found = (
            rows.groupBy(_cell(F.col("digest"), bits).alias("cell"))
            .agg(F.sum("bytes").alias("total"), F.count("*").alias("n"), F.max("bytes").alias("largest"))
            .collect()
        )
        columns = ([r[k] for r in found] for k in ("cell", "total", "n", "largest"))
        start, total, n, largest = (np.array(x, dtype=np.int64) for x in columns)
        return start, total, np.where(n == 1, 64, bits), largest

    start, total, bits, largest = look(FIRST_BITS)
    if not len(start):
        return [], 0
    low = max(-(-int(total.sum()) // shards), int(largest.max()))
    while True:
        line = _Line(start, total, bits)
        near = (line.bits < 64) & (line.total > low)
        if not near.any():
            best = line.smallest(shards, low)
            if best == low:
                break
            # Cut k lies at or after the coarse cut for the bound and within k capacities.
            for k, first in enumerate(line.greedy(low, shards - 1), 1):
                last = int(np.searchsorted(line.end, k * best, "right"))
                near[max(first - 1, 0) : last + 1] = True
            near &= line.bits < 64
            if not near.any():
                break
        parts = [(line.start[~near], line.total[~near], line.bits[~near])]
        for b in np.unique(line.bits[near]).tolist():
            cells = line.start[near & (line.bits == b)].tolist()
            parts.append(look(min(64, b + MORE_BITS), b, cells)[:3])
        start, total, bits = (np.concatenate(x) for x in zip(*parts))
    cuts, atom = [], 0
    for left in range(shards - 1, 0, -1):
        if atom >= len(line.end):
            break
        here = line.before(atom)
        even = here + (int(line.end[-1]) - here) / (left + 1)
        most = line.greedy(best, 1, atom)[0]
        after = int(np.searchsorted(line.end, even, "left"))
        choices = sorted({atom + 1, after, after + 1}, key=lambda a: abs(line.before(a) - even))
        atom = next((a for a in choices if atom < a <= most and line.fits(best, left, a)), most)
        if atom < len(line.end):
            cuts.append(int(line.start[atom]))
    return cuts, best


def shard(docs: DataFrame, shards: int = 24, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per row of ``docs``: its size, group digest, shard, and slot in the shard.

    Equal texts share a shard. Sizes are UTF-8 bytes plus ``ROW_BYTES``; the largest
    shard is as small as contiguous cuts allow, and the others are cut as evenly as that
    bound lets them. Slots run from 0 without a gap.
    """
    prepare(docs.sparkSession)
    whole = F.coalesce(F.col(text), F.lit(""))
    rows = stage(
        docs.select(
            F.col(key).alias("doc_id"),
            (F.octet_length(whole).cast("long") + ROW_BYTES).alias("size"),
            F.crc32(whole.cast("binary")).alias("text_crc32"),
            F.xxhash64(whole).alias("digest"),
        ),
        "shard_rows",
    )
    groups = rows.groupBy("digest").agg(F.sum("size").alias("bytes"), F.count("*").alias("copies"))
    groups = stage(groups, "shard_groups")
    cuts, _ = minimax_cuts(groups, shards)
    number = F.lit(0)
    for cut in cuts:
        number = number + (F.col("digest") >= F.lit(cut)).cast("int")
    n = groups.agg(F.sum("copies")).first()[0] or 0
    units = max(1, min(MOST_UNITS, n // (shards * UNIT_ROWS)))
    placed = rows.select(
        "*", number.alias("shard"), F.pmod(F.xxhash64("doc_id", "digest", F.lit(7)), F.lit(units)).alias("unit")
    )
    counts = placed.groupBy("shard", "unit").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("shard").orderBy("unit").rowsBetween(Window.unboundedPreceding, -1)
    begins = counts.select(
        "shard", "unit", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("begin")
    )
    inside = Window.partitionBy("shard", "unit").orderBy("doc_id", "digest")
    return (
        placed.withColumn("place", F.row_number().over(inside) - 1)
        .join(begins, ["shard", "unit"])
        .select(
            "doc_id",
            "size",
            "text_crc32",
            "digest",
            "shard",
            (F.col("begin") + F.col("place")).alias("slot"),
        )
    )
