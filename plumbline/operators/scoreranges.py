"""Thresholds and metrics of many scores of a row at once.

Scores stay columns of their row: no row is copied per variant, and no shuffle carries a row
per score. Groups and their records are counted first. Scores of a group with many records
are dealt to ranges of like size, whose bounds a sample gives; the scores that a task meets
are counted, sorted, cut at the bounds and packed into one row per group, score and range. A
range is ranked by one task, and the few ranges are chained by running sums. Every score
counts: the sample decides only which task ranks it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping
from functools import reduce
from itertools import pairwise

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.operators.evaluate import UNSCORED, _worth, totals

# Scores that one task ranks, rows whose scores bound the ranges, and rows that a task packs at once.
RANGE, BOUNDING, CHUNK = 1 << 19, 20_000, 200_000
# Two values that are equal at 9 places differ by no more than this.
NEAR = 2e-9

Scored = Callable[[DataFrame], DataFrame]


def gathered(batches: Iterator[pd.DataFrame], size: int) -> Iterator[pd.DataFrame]:
    """Batches put together until they have ``size`` rows."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += len(batch)
        if n >= size:
            yield pd.concat(held, ignore_index=True)
            held, n = [], 0
    if n:
        yield pd.concat(held, ignore_index=True)


class _Groups:
    """The groups of the labelled rows, which are few, by number ``_group``; a null key is a key."""

    def __init__(self, rows: DataFrame, keys: list[str], y: str):
        rows = rows.where(F.col(y).isNotNull())
        of_class = lambda c: F.count(F.when(F.col(y) == c, 1))
        sizes = [of_class(1).alias("_pos"), of_class(0).alias("_neg"), F.count("*").alias("_n")]
        counted = rows.groupBy(*keys).agg(*sizes).where("_n > 0")
        found = counted.collect()
        self.keys, self.kinds = keys, [counted.schema[k] for k in keys]
        self.pos, self.neg, self.n = ([r[c] for r in found] for c in ("_pos", "_neg", "_n"))
        self.values = [tuple(r[k] for k in keys) for r in found]
        self.rows = self.numbered(rows)

    def table(self, rows: list[tuple], *kinds: T.StructField) -> DataFrame:
        return self.session.createDataFrame(rows, T.StructType([T.StructField("_group", T.IntegerType()), *kinds]))

    def numbered(self, rows: DataFrame) -> DataFrame:
        self.session = rows.sparkSession
        if not self.keys:
            return rows.withColumn("_group", F.lit(0))
        named = [T.StructField(f"_key_{f.name}", f.dataType) for f in self.kinds]
        side = self.table([(g, *v) for g, v in enumerate(self.values)], *named)
        return _joined(rows, side, {k: f"_key_{k}" for k in self.keys}).drop(*[f.name for f in named])


def _joined(rows: DataFrame, side: DataFrame, on: Mapping[str, str]) -> DataFrame:
    same = reduce(lambda a, b: a & b, [F.col(a).eqNullSafe(F.col(b)) for a, b in on.items()])
    return rows.join(F.broadcast(side), same)


def _bounds(groups: _Groups, scored: Scored, columns: list[str]) -> dict[tuple[int, int], np.ndarray]:
    """Where the scores of the larger groups are cut into ranges."""
    large = {g: -(-n // RANGE) for g, n in enumerate(groups.n) if n > RANGE}
    if not large:
        return {}
    some = groups.rows.where(F.col("_group").isin(list(large)))
    some = scored(some.sample(min(1.0, BOUNDING * len(large) / sum(groups.n[g] for g in large)), 42))
    most = max(large.values())
    cuts = [F.percentile_approx(F.coalesce(c, F.lit(UNSCORED)), [j / (4 * most) for j in range(1, 4 * most)], 10_000).alias(c) for c in columns]
    out = {}
    for r in some.groupBy("_group").agg(*cuts).collect():
        places = [4 * most * j // large[r["_group"]] - 1 for j in range(1, large[r["_group"]])]
        out.update({(r["_group"], k): np.unique(np.array(r[c])[places]) for k, c in enumerate(columns)})
    return out


def _bytes(counts: np.ndarray) -> bytes:
    return counts.astype("u1" if counts.max(initial=0) < 256 else "i8").tobytes()


def _counts(parts: pd.Series, sizes: list[int]) -> np.ndarray:
    return np.concatenate([np.frombuffer(b, "u1" if len(b) == n else "i8").astype(np.int64) for b, n in zip(parts, sizes)])


def _distinct(s: np.ndarray, *counts: np.ndarray) -> tuple[np.ndarray, ...]:
    """Rising scores, each once, with the sums of its counts; a NaN is the highest score, as Spark has it."""
    order = np.argsort(s, kind="stable")
    s = s[order]
    new = np.r_[True, (s[1:] != s[:-1]) & ~(np.isnan(s[1:]) & np.isnan(s[:-1]))][: len(s)]
    starts = np.flatnonzero(new)
    return s[starts], *(np.add.reduceat(c[order], starts) for c in counts)


def packed(groups: _Groups, scored: Scored, columns: list[str], y: str) -> DataFrame:
    """Counted scores, packed: ``_group``, ``_k`` (number of the score), ``_part`` (its range), and the
    bytes of the scores, of their positive and of their negative records."""
    bounds = _bounds(groups, scored, columns)

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in gathered(batches, CHUNK):
            g, label = rows["_group"].to_numpy(), rows["_y"].to_numpy()
            order = np.argsort(g, kind="stable")
            g, out = g[order], []
            starts = np.flatnonzero(np.r_[True, g[1:] != g[:-1]])
            for low, high in pairwise([*starts, len(g)]):
                mine = order[low:high]
                pos, neg = ((label[mine] == c).astype(np.int64) for c in (1, 0))
                for k, c in enumerate(columns):
                    s, p, n = _distinct(rows[c].to_numpy()[mine] + 0.0, pos, neg)
                    edges = np.searchsorted(s, bounds.get((g[low], k), []))
                    for part, (a, b) in enumerate(pairwise([0, *edges, len(s)])):
                        if a < b:
                            out.append((g[low], k, part, s[a:b].tobytes(), _bytes(p[a:b]), _bytes(n[a:b])))
            yield pd.DataFrame(out, columns=["_group", "_k", "_part", "s", "p", "n"])

    label = F.when(F.col(y) == 1, 1).when(F.col(y) == 0, 0).otherwise(2).alias("_y")
    ranks = [F.coalesce(F.col(c).cast("double"), F.lit(UNSCORED)).alias(c) for c in columns]
    wide = scored(groups.rows).select("_group", label, *ranks)
    return wide.mapInPandas(deal, "_group int, _k int, _part int, s binary, p binary, n binary")


def _unpacked(part: pd.DataFrame) -> tuple[np.ndarray, ...]:
    s = [np.frombuffer(b) for b in part["s"]]
    sizes = [len(x) for x in s]
    return _distinct(np.concatenate(s), _counts(part["p"], sizes), _counts(part["n"], sizes))


_NAME = ("_group", "_k", "_part")


def thresholds(rows: DataFrame, scored: Scored, keys: list[str], scores: Mapping[str, str], y: str = "y") -> DataFrame:
    """M3 for several scores: ``keys``, ``variant``, ``theta`` and its Youden index, as ``fit_threshold``
    has them for a row per variant.

    ``scored`` adds the scores to any of the ``rows`` (variant: column, in ``scores``) and keeps
    ``_group`` and ``y``; ``keys`` are columns of ``rows``. A range offers the scores that may be best:
    records above it add the same to all of them, so only those near its own best one.
    """
    groups = _Groups(rows, keys, y)
    of_group = dict(enumerate(zip(groups.pos, groups.neg)))

    def offer(part: pd.DataFrame) -> pd.DataFrame:
        s, p, n = _unpacked(part)
        pos, neg = of_group[part["_group"].iloc[0]]
        tp, fp = (np.cumsum(c[::-1])[::-1] for c in (p, n))
        some = np.flatnonzero((s >= 0) | np.isnan(s))
        if pos and neg:
            worth = tp[some] / pos - fp[some] / neg
            near = np.flatnonzero(worth >= worth.max(initial=-np.inf) - NEAR)
            some = some[near[np.unique(worth[near], return_index=True)[1]]]  # of equal ones the lowest score
        else:
            some = some[:1]
        row = (*part[list(_NAME)].iloc[0], p.sum(), n.sum(), s[some], tp[some], fp[some])
        return pd.DataFrame([row], columns=[*_NAME, "pos", "neg", "s", "tp", "fp"])

    kinds = "_group int, _k int, _part int, pos long, neg long, s array<double>, tp array<long>, fp array<long>"
    offers = packed(groups, scored, list(scores.values()), y).groupBy(*_NAME).applyInPandas(offer, kinds)
    above = Window.partitionBy("_group", "_k").orderBy(F.desc("_part")).rowsBetween(Window.unboundedPreceding, -1)
    out = {c: F.coalesce(F.sum(c).over(above), F.lit(0)) for c in ("pos", "neg")}
    tried = offers.withColumns({f"_{c}_above": x for c, x in out.items()}).select(
        "_group", "_k", "_pos_above", "_neg_above", F.inline(F.arrays_zip("s", "tp", "fp"))
    )
    sizes = [(g, *of_group[g]) for g in of_group]
    sizes = groups.table(sizes, *[T.StructField(c, T.LongType()) for c in ("_pos", "_neg")]).withColumnRenamed("_group", "_of")
    tried = _joined(tried, sizes, {"_group": "_of"})
    tp, fp = F.col("_pos_above") + F.col("tp"), F.col("_neg_above") + F.col("fp")
    tried = tried.select("_group", "_k", F.coalesce("s", F.lit(float("nan"))).alias("s"), _worth("youden", tp, fp, F.col("_pos"), F.col("_neg")).alias("_value"))
    best = F.min_by(F.struct(F.col("s").alias("theta"), F.col("_value").alias("youden")), F.struct(-F.col("_value"), F.col("s")))
    found = tried.groupBy("_group", "_k").agg(best.alias("_b"))
    return _named(groups, found, list(scores)).select(*keys, "variant", "_b.theta", "_b.youden")


def _named(groups: _Groups, found: DataFrame, variants: list[str], fitted: Mapping[tuple[int, str], float] | None = None) -> DataFrame:
    """``found`` with the keys, the variant and, where given, the threshold of its (``_group``, ``_k``)."""
    kinds = [T.StructField("_nth", T.IntegerType()), *groups.kinds, T.StructField("variant", T.StringType())]
    more = [] if fitted is None else [T.StructField("theta", T.DoubleType())]
    rows = [
        (g, k, *values, name, *([] if fitted is None else [fitted.get((g, name))]))
        for g, values in enumerate(groups.values)
        for k, name in enumerate(variants)
    ]
    side = groups.table(rows, *kinds, *more).withColumnRenamed("_group", "_of")
    return _joined(found, side, {"_group": "_of", "_k": "_nth"})


def measures(
    rows: DataFrame, scored: Scored, keys: list[str], scores: Mapping[str, str], theta: DataFrame, y: str = "y"
) -> DataFrame:
    """E1 and E2 for several scores: what ``metrics`` gives by ``keys``, ``variant`` and ``theta``.

    ``theta`` has a threshold per variant and some or all of the ``keys``; ``rows``, ``scored`` and
    ``scores`` as for ``thresholds``.
    """
    groups = _Groups(rows, keys, y)
    own = [k for k in keys if k in theta.columns]
    at = {(*[str(r[k]) for k in own], r["variant"]): r["theta"] for r in theta.collect()}
    place = [keys.index(k) for k in own]
    fitted = {(g, n): at.get((*[str(v[j]) for j in place], n)) for g, v in enumerate(groups.values) for n in scores}
    variants = list(scores)

    def rank(part: pd.DataFrame) -> pd.DataFrame:
        s, p, n = _unpacked(part)
        least = fitted[part["_group"].iloc[0], variants[part["_k"].iloc[0]]]
        none = s == UNSCORED
        over = np.zeros(len(s), bool) if least is None else ~none & ((s >= least) | np.isnan(s))
        wins = p @ (np.cumsum(n) - n / 2)
        miss = np.where(none, 0.0, p * (1 - s) ** 2 + n * s**2).sum()
        row = (*part[list(_NAME)].iloc[0], p.sum(), n.sum(), wins, p[over].sum(), n[over].sum(), miss, np.isnan(miss), (p + n)[none].sum())
        return pd.DataFrame([row], columns=[*_NAME, "pos", "neg", "_wins", "tp", "fp", "_sse", "_nan", "n_unscored"])

    kinds = "_group int, _k int, _part int, pos long, neg long, _wins double, tp long, fp long, _sse double, _nan boolean, n_unscored long"
    cells = packed(groups, scored, list(scores.values()), y).groupBy(*_NAME).applyInPandas(rank, kinds)
    lower = Window.partitionBy("_group", "_k").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    below = F.col("pos").cast("double") * F.coalesce(F.sum("neg").over(lower), F.lit(0))
    # What comes from pandas has nulls for NaN.
    sse = F.when(F.col("_nan"), F.lit(float("nan"))).otherwise(F.col("_sse"))
    found = totals(cells.withColumns({"_wins": F.col("_wins") + below, "_sse": sse}), ["_group", "_k"])
    out = [c for c in found.columns if c not in _NAME]
    return _named(groups, found, variants, fitted).select(*keys, "variant", "theta", *out)
