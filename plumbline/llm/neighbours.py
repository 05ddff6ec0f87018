"""Approximate nearest neighbours by inner product: a vantage-point tree per shard.

Rows are dealt to shards by a hash of their id. A shard's tree splits its vectors at the
median distance from a vantage point, again and again. Inner product becomes a distance
by one more coordinate that gives all vectors of the shard the same length; the largest
product is then the smallest distance, and the triangle inequality prunes: a half that
lies farther from the query than ``factor`` times the k-th best distance is not visited.
Factor 1 searches exactly, smaller ones visit less.

Queries are a stated set; they meet every shard in blocks of bounded size, and each pair
of shard and block returns ``k`` rows per query, which are merged by rank. Vectors that
many rows share are one point of the tree with its smallest ids.

Defined cases: vectors that are null, empty or zero, or hold a null or non-finite
component, and rows with a null id, take no part; candidates of a query have its
dimension; repeated rows count once; ties go to the smaller id; a query with fewer than
``k`` candidates gets all; empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import prepare
from plumbline.session import stage

#: Rows of a shard and queries of a block, on average; points of a leaf.
SHARD_ROWS, BLOCK_ROWS, LEAF = 8192, 8192, 256
#: Share of the k-th best distance within which the triangle inequality keeps a half.
FACTOR = 1.0
#: Further candidates kept until products are computed again in double precision, term by term.
MARGIN = 4


def usable(vector: Column) -> Column:
    """As doubles, or null if the vector takes no part."""
    v = F.transform(vector, lambda x: x.cast("double"))
    fine = lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), F.lit(False))
    return F.when(F.forall(v, fine) & F.exists(v, lambda x: x != 0), v)


class Tree:
    """Vantage-point tree over the rows of ``points``."""

    def __init__(self, points: np.ndarray, leaf: int = LEAF):
        length = (points**2).sum(axis=1)
        self.points, self.square = points, float(length.max())
        lifted = np.column_stack([points, np.sqrt(np.maximum(self.square - length, 0))])
        self.order = np.arange(len(points))
        self.root = self._build(lifted, 0, len(points), leaf)
        self.points = points[self.order]

    def _build(self, lifted, begin, end, leaf):
        if end - begin <= leaf:
            return (begin, end, None, 0.0, None, None)
        at = self.order[begin:end].copy()
        # Of a few points spread over the range, the one whose distances vary most.
        some = at[:: max(1, len(at) // 8)][:8]
        away = [np.sqrt(((lifted[at] - lifted[s]) ** 2).sum(axis=1)) for s in some]
        best = int(np.argmax([d.std() for d in away]))
        middle = len(at) // 2
        self.order[begin:end] = at[np.argsort(away[best], kind="stable")]
        radius = float(np.partition(away[best], middle)[middle])
        inner = self._build(lifted, begin, begin + middle, leaf)
        outer = self._build(lifted, begin + middle, end, leaf)
        return (begin, end, lifted[some[best]], radius, inner, outer)

    def search(self, queries: np.ndarray, k: int, factor: float) -> tuple[np.ndarray, np.ndarray]:
        """Rows of the ``k`` largest products of each query, and whether there are so many."""
        k = min(k, len(self.points))
        best = np.full((len(queries), k), -np.inf)
        rows = np.full((len(queries), k), -1)
        length = (queries**2).sum(axis=1) + self.square
        flat = np.column_stack([queries, np.zeros(len(queries))])
        slack = 1e-9 * np.sqrt(length)

        def reach(q):
            return np.sqrt(np.maximum(length[q] - 2 * best[q, -1], 0)) * factor + slack[q]

        def visit(node, q):
            begin, end, vantage, radius, inner, outer = node
            if vantage is None:
                product = np.concatenate([best[q], queries[q] @ self.points[begin:end].T], axis=1)
                place = np.concatenate([rows[q], np.broadcast_to(np.arange(begin, end), (len(q), end - begin))], axis=1)
                top = np.argpartition(-product, k - 1, axis=1)[:, :k]
                product = np.take_along_axis(product, top, 1)
                by = np.argsort(-product, axis=1)
                best[q] = np.take_along_axis(product, by, 1)
                rows[q] = np.take_along_axis(np.take_along_axis(place, top, 1), by, 1)
                return
            away = np.sqrt(((flat[q] - vantage) ** 2).sum(axis=1))
            inside = away < radius
            for near, far, mine, gap in ((inner, outer, inside, radius - away), (outer, inner, ~inside, away - radius)):
                if mine.any():
                    own = q[mine]
                    visit(near, own)
                    more = gap[mine] <= reach(own)
                    if more.any():
                        visit(far, own[more])

        if len(queries):
            visit(self.root, np.arange(len(queries)))
        return np.where(rows >= 0, self.order[rows], -1), best


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row-wise inner products, added up from the first term on."""
    out = np.zeros(len(a))
    for d in range(a.shape[1]):
        out += a[:, d] * b[:, d]
    return out


def _vectors(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def _searcher(k: int, factor: float) -> Callable[[pa.Table], pa.Table]:
    def run(group: pa.Table) -> pa.Table:
        asks = group.column("ask").to_numpy(zero_copy_only=False).astype(bool)
        ids = group.column("vec_id").to_numpy(zero_copy_only=False)
        vectors = _vectors(group.column("vector"))
        names = ["query_id", "vec_id", "score"]
        empty = pa.table([pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], pa.float64())], names)
        if asks.all() or not asks.any():
            return empty
        points, of = np.unique(vectors[~asks], axis=0, return_inverse=True)
        own = np.unique(np.column_stack([of.reshape(-1), ids[~asks]]), axis=0)  # by point, then id
        begins = np.searchsorted(own[:, 0], np.arange(len(points) + 1))
        first = own[begins[:-1], 1]
        tree = Tree(points)
        found, best = tree.search(vectors[asks], k + 1 + MARGIN, factor)
        slack = 1e-9 * np.sqrt(tree.square * (vectors[asks] ** 2).sum(axis=1))
        # More points than are kept may be equally near: then all of them are looked at again.
        tied = (found.shape[1] < len(points)) & (best[:, -1] >= best[:, min(k, best.shape[1] - 1)] - slack)
        out = []
        for nth, (q, vector, rows) in enumerate(zip(ids[asks].tolist(), vectors[asks], found)):
            rows = rows[rows >= 0]
            if tied[nth]:
                rows = np.flatnonzero(points @ vector >= best[nth, min(k, best.shape[1] - 1)] - slack[nth])
            score = products(np.broadcast_to(vector, (len(rows), len(vector))), points[rows])
            # The k + 1 first by score and smallest id hold all that can be returned.
            top = np.lexsort((first[rows], -score))[: k + 1]
            rows, score = rows[top], score[top]
            each = [
                (-s, int(i))
                for r, s in zip(rows.tolist(), score.tolist())
                for i in own[begins[r] : min(begins[r] + k + 1, begins[r + 1]), 1]
                if i != q
            ]
            out.extend((q, i, -s) for s, i in sorted(each)[:k])
        columns = list(zip(*out)) or [[], [], []]
        types = (pa.int64(), pa.int64(), pa.float64())
        return pa.table([pa.array(c, t) for c, t in zip(columns, types)], names)

    return run


def nearest(
    table: DataFrame,
    is_query: Column,
    k: int = 20,
    factor: float = FACTOR,
    key: str = "vec_id",
    vector: str = "embedding",
) -> DataFrame:
    """query_id, rank (from 1), vec_id, score of the ``k`` nearest rows of each query."""
    prepare(table.sparkSession)
    rows = table.select(
        F.col(key).cast("long").alias("vec_id"), is_query.alias("ask"), usable(F.col(vector)).alias("vector")
    ).where(F.col("vec_id").isNotNull() & F.col("vector").isNotNull())
    rows = stage(rows.withColumns({"dim": F.size("vector"), "ask": F.coalesce("ask", F.lit(False))}), "vectors")
    n, asked = rows.agg(F.count("*"), F.count_if("ask")).first()
    shards, blocks = max(1, -(-n // SHARD_ROWS)), max(1, -(-asked // BLOCK_ROWS))
    part = lambda seed, n: F.pmod(F.xxhash64("vec_id", F.lit(seed)), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    data = rows.select("dim", part(1, shards).alias("shard"), every(blocks).alias("block"), "vec_id", F.lit(False).alias("ask"), "vector")
    asks = rows.where("ask").select(
        "dim", every(shards).alias("shard"), part(2, blocks).alias("block"), "vec_id", F.lit(True).alias("ask"), "vector"
    )
    found = (
        data.unionAll(asks.dropDuplicates())
        .groupBy("dim", "shard", "block")
        .applyInArrow(_searcher(k, factor), "query_id long, vec_id long, score double")
    )
    ranked = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        found.withColumn("rank", F.row_number().over(ranked))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
