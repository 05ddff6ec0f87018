"""MinHash near-dedup by an LSH forest: sorted orders of MinHash signatures, whose longest common prefixes name candidates.

A text's set is its distinct four-word shingles. Two sets link when their Jaccard similarity
is at least 4/5; links are confirmed on full sets.

1. Texts with equal sets are one node. A node's signature holds TREES * DEPTH minima. Order t
   of the forest sorts nodes by the signature rotated to its t-th run of DEPTH minima; nodes
   that share that run are a region of the order. A linked pair misses the regions of all
   orders with a probability of (1 - 0.8**DEPTH)**TREES, about one in a million, at most.
2. Nodes of a region whose signatures agree often enough are tied. A region of very many
   nodes is not gathered: all its nodes are tied to its least one. Tied nodes are clusters.
   Agreement is asked for with a margin of five standard deviations.
3. Only the texts of clusters are read again. A cluster is searched by one task or, beyond a
   bound, as pairs of blocks of bounded size, so that nothing is cut off. The search goes
   through all orders from deep prefixes to shallow ones: where a region is dense, its nodes
   meet their neighbours of longest common prefix first, and what is connected by confirmed
   links is one component and is not compared again at lesser depth.

Nodes are told apart by a 64-bit hash of their set, and shingles by 64-bit hashes. Sets and
signatures never leave the tasks; the driver handles no more than counts.

Defined cases: a text without words, or null, has an empty set and is linked with nothing;
repeated rows, having equal sets, link; a null doc_id takes part in links and is never a
component's name unless all its ids are null; ``kept`` compares null-safely, so rows without
an id are kept only if their component has no id at all; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import prepare
from plumbline.llm.components import components
from plumbline.llm.words import mix, shingle_sets
from plumbline.operators.joins import salted_lookup
from plumbline.session import stage

#: Links need 100 * overlap >= PERCENT * union, on shingles of SHINGLE words.
PERCENT, SHINGLE = 80, 4
#: Sorted orders, and minima of the prefix that makes a region.
TREES, DEPTH = 26, 4
WIDTH = TREES * DEPTH
#: Equal minima that make a candidate: five standard deviations below the least similarity.
AGREE = int(WIDTH * 0.8 - 5 * (WIDTH * 0.8 * 0.2) ** 0.5)
#: Prefix lengths that a search goes through.
DEPTHS = (16, 8, DEPTH)
#: Nodes of a region that one task compares; rows of regions in a task; shingles searched at once.
REGION, ROWS, CLUSTER = 1000, 500_000, 2_000_000

_NO_ID = np.iinfo(np.int64).max
_FACTORS = mix(np.arange(1, WIDTH + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
_SHIFTS = mix(np.arange(1, WIDTH + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))


def signature(shingles: np.ndarray) -> np.ndarray:
    """WIDTH minima of 32 bits; ``shingles`` is not empty."""
    out = np.empty(WIDTH, dtype=np.uint32)
    for k in range(WIDTH):
        out[k] = (shingles * _FACTORS[k] + _SHIFTS[k]).min() >> np.uint64(32)
    return out


def regions(minima: np.ndarray) -> np.ndarray:
    """One 64-bit name per order, of the order and its run of minima."""
    run = minima.reshape(TREES, DEPTH).astype(np.uint64)
    name = np.arange(1, TREES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for k in range(DEPTH):
        name = mix(name ^ run[:, k])
    return name.view(np.int64)


_SIGNED = "doc_id long, mark long, node long, n int, regions array<long>, sig binary"


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        nodes, sizes, names, sigs = [], [], [], []
        for s in shingle_sets(b.column(2).to_pylist(), SHINGLE):
            sizes.append(len(s))
            if not len(s):
                nodes.append(0)
                names.append(None)
                sigs.append(None)
                continue
            nodes.append(int(mix(np.array([mix(s).sum() + np.uint64(len(s))], dtype=np.uint64)).view(np.int64)[0]))
            minima = signature(s)
            names.append(regions(minima))
            sigs.append((minima & np.uint32(255)).astype(np.uint8).tobytes())
        yield pa.RecordBatch.from_arrays(
            [
                b.column(0),
                b.column(1),
                pa.array(nodes, pa.int64()),
                pa.array(sizes, pa.int32()),
                pa.array(names, pa.list_(pa.int64())),
                pa.array(sigs, pa.binary()),
            ],
            ["doc_id", "mark", "node", "n", "regions", "sig"],
        )


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint8).reshape(-1, WIDTH)


class Forest:
    """Nodes of one task: connected by confirmed links, which ``link`` decides."""

    def __init__(self, sigs: np.ndarray, link=None):
        self.sigs, self.link = sigs, link
        self.label = np.arange(len(sigs))
        self.members = {}
        self.failed: set[tuple[int, int]] = set()
        self.links: list[tuple[int, int]] = []

    def join(self, a: int, b: int) -> None:
        """The smaller component takes the larger one's label."""
        x, y = int(self.label[a]), int(self.label[b])
        of = lambda l: self.members.pop(l, None) or [l]
        p, q = of(x), of(y)
        if len(p) > len(q):
            x, y, p, q = y, x, q, p
        self.label[p] = y
        self.members[y] = q + p
        self.links.append((a, b))

    def compare(self, a: int, b: int) -> None:
        if self.label[a] == self.label[b]:
            return
        if self.link:
            pair = (min(a, b), max(a, b))
            if pair in self.failed:
                return
            if not self.link(a, b):
                self.failed.add(pair)
                return
        self.join(a, b)

    def region(self, at: np.ndarray) -> None:
        """All pairs of nodes at ``at`` that are not connected and whose signatures agree."""
        labels, counts = np.unique(self.label[at], return_counts=True)
        if len(labels) == 1:
            return
        # Against the most frequent component only the others are compared.
        some = at[self.label[at] != labels[counts.argmax()]]
        for a in some.tolist():
            others = at[self.label[at] != self.label[a]]
            agree = (self.sigs[others] == self.sigs[a]).sum(axis=1)
            fit = agree >= AGREE
            others, agree = others[fit], agree[fit]
            for b in others[np.argsort(-agree, kind="stable")].tolist():
                self.compare(a, b)

    def search(self) -> list[tuple[int, int]]:
        """Links that connect what is linked: a spanning forest."""
        orders = []
        for t in range(TREES):
            turned = np.ascontiguousarray(np.roll(self.sigs, -t * DEPTH, axis=1)[:, : DEPTHS[0]])
            order = np.argsort(turned.view(f"V{DEPTHS[0]}").ravel(), kind="stable")
            turned = turned[order]
            differ = turned[1:] != turned[:-1]
            common = np.where(differ.any(axis=1), differ.argmax(axis=1), DEPTHS[0])
            orders.append((order, common))
        for depth in DEPTHS:
            for order, common in orders:
                cuts = np.flatnonzero(common < depth) + 1
                bounds = np.concatenate([[0], cuts, [len(order)]])
                for k in np.flatnonzero(np.diff(bounds) > 1).tolist():
                    self.region(order[bounds[k] : bounds[k + 1]])
        return self.links


def _tie(group: pa.Table) -> pa.Table:
    """Nodes of equal regions whose signatures agree, as a spanning forest of each region."""
    names, nodes = group.column("region").to_numpy(), group.column("node").to_numpy()
    order = np.lexsort((nodes, names))
    names, nodes, sigs = names[order], nodes[order], _matrix(group.column("sig"))[order]
    bounds = np.concatenate([[0], np.flatnonzero(names[1:] != names[:-1]) + 1, [len(names)]])
    sizes = np.diff(bounds)
    two = bounds[:-1][sizes == 2]
    fit = two[(sigs[two] == sigs[two + 1]).sum(axis=1) >= AGREE]
    a, b = [nodes[fit]], [nodes[fit + 1]]
    for k in np.flatnonzero(sizes > 2).tolist():
        part = slice(bounds[k], bounds[k + 1])
        forest = Forest(sigs[part])
        forest.region(np.arange(sizes[k]))
        if forest.links:
            x, y = np.array(forest.links).T
            a.append(nodes[part][x])
            b.append(nodes[part][y])
    a, b = np.concatenate(a), np.concatenate(b)
    if len(a):
        a, b = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)]), axis=1)
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        text = b.schema.get_field_index("text")
        sets = [s.tobytes() for s in shingle_sets(b.column(text).to_pylist(), SHINGLE)]
        yield b.set_column(text, "keys", pa.array(sets, pa.binary()))


_LINKS = "a_least long, a long, b_least long, b long"


def _search(group: pa.Table) -> pa.Table:
    """Confirmed links within the clusters of a group."""
    group = group.sort_by([("cluster", "ascending"), ("node", "ascending")])
    clusters, nodes = group.column("cluster").to_numpy(), group.column("node").to_numpy()
    least, sigs = group.column("least").to_numpy(), _matrix(group.column("sig"))
    sets = [np.frombuffer(k, dtype=np.uint64) for k in group.column("keys").to_pylist()]
    bounds = [0, *(np.flatnonzero(clusters[1:] != clusters[:-1]) + 1).tolist(), len(clusters)]
    a, b = [], []
    for begin, end in zip(bounds, bounds[1:]):

        def link(x: int, y: int) -> bool:
            s, t = sets[begin + x], sets[begin + y]
            if len(s) > len(t):
                s, t = t, s
            overlap = int((t[np.searchsorted(t, s).clip(0, len(t) - 1)] == s).sum())
            return 100 * overlap >= PERCENT * (len(s) + len(t) - overlap)

        for x, y in Forest(sigs[begin:end], link).search():
            a.append(begin + x)
            b.append(begin + y)
    longs = lambda values, at: pa.array(values[np.array(at, dtype=np.int64)], pa.int64())
    return pa.table({"a_least": longs(least, a), "a": longs(nodes, a), "b_least": longs(least, b), "b": longs(nodes, b)})


def near_copies(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id reachable by links) and kept of every row."""
    spark = prepare(docs.sparkSession)
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.xxhash64(text).alias("mark"), F.col(text).alias("text"))
    signed = stage(rows.mapInArrow(_sign, _SIGNED), "forest_signed")
    nodes = signed.where("n > 0").groupBy("node").agg(
        F.coalesce(F.min("doc_id"), F.lit(_NO_ID)).alias("least"),
        F.min("mark").alias("mark"),
        F.any_value("n").alias("n"),
        F.any_value("regions").alias("regions"),
        F.any_value("sig").alias("sig"),
    )
    nodes = stage(nodes, "forest_nodes")
    places = nodes.select("node", F.explode("regions").alias("region"))
    shared = places.groupBy("region").agg(F.count("*").alias("size"), F.min("node").alias("low")).where("size > 1")
    shared = places.join(stage(shared, "forest_regions"), "region")
    shared = stage(shared, "forest_places")
    dense = shared.where(F.col("size") > REGION).select(F.col("low").alias("a"), F.col("node").alias("b"))
    sparse = shared.where(F.col("size") <= REGION)
    tasks = max(1, -(-sparse.count() // ROWS))
    ties = (
        sparse.select(F.pmod(F.xxhash64("region"), F.lit(tasks)).alias("task"), "region", "node")
        .join(nodes.select("node", "sig"), "node")
        .groupBy("task")
        .applyInArrow(_tie, "a long, b long")
    )
    clusters = components(dense.unionAll(ties)).withColumnRenamed("component", "cluster")
    members = stage(clusters.join(nodes.drop("regions"), "node"), "forest_members")
    weights = stage(members.groupBy("cluster").agg(F.sum("n").alias("weight")), "forest_weights")
    tasks = max(1, -(-(weights.agg(F.sum("weight")).first()[0] or 0) // CLUSTER))
    members = salted_lookup(members, weights, "cluster", "node")
    # Each node's text once, whatever the number of its copies.
    found = rows.select("mark", "text").join(members, "mark").groupBy("node").agg(
        *(F.any_value(c).alias(c) for c in ("cluster", "least", "weight", "sig", "text"))
    )
    blocks = F.ceil(F.col("weight") / F.lit(CLUSTER // 2)).cast("int")
    large = F.col("weight") > CLUSTER
    own = F.pmod(F.xxhash64("node"), blocks).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.when(large, blocks - 1).otherwise(0)))
    sets = found.mapInArrow(_sets, "node long, cluster long, least long, weight long, sig binary, keys binary")
    pair = F.when(
        large, F.concat_ws(":", "cluster", F.least("own", "other").cast("string"), F.greatest("own", "other").cast("string"))
    ).otherwise(F.pmod(F.xxhash64("cluster"), F.lit(tasks)).cast("string"))
    links = (
        sets.select("*", own.alias("own"))
        .select("*", other.alias("other"))
        .select(pair.alias("task"), "cluster", "node", "least", "sig", "keys")
        .groupBy("task")
        .applyInArrow(_search, _LINKS)
    )
    # Components of (least doc_id, node): the smallest member brings the component's name along.
    member = lambda side: F.struct(F.col(f"{side}_least").alias("least"), F.col(side).alias("node"))
    linked = components(links.select(member("a").alias("a"), member("b").alias("b")))
    linked = linked.select(F.col("node.node").alias("node"), F.col("component.least").alias("first"))
    names = nodes.select("node", "least").join(linked, "node", "left")
    names = stage(names.select("node", F.coalesce("first", "least").alias("first")), "forest_names")
    named = signed.select("doc_id", "node", "n").join(names, "node", "left")
    component = F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.nullif("first", F.lit(_NO_ID)))
    out = named.select("doc_id", F.col("n").cast("long").alias("n_shingles"), component.alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
