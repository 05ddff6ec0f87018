"""N-gram Jaccard join: every pair of texts whose shingle sets are similar enough, by T-occurrence search.

A text's set is its distinct five-word shingles. Two sets link when their Jaccard
similarity is at least 3/4, which is an overlap of 3/7 of the sum of their sizes.

1. Texts with equal sets are one node. A node's shingles go to buckets by hash; a bucket
   learns in how many nodes each occurs and tells the nodes of those that recur. A shingle
   that is common already within one task's portion is "long" and is not gathered: it is
   reported to its nodes at once and ordered last. All nodes so agree on one order, by
   number of nodes and hash, in which shingles of one node only come first.
2. A node of n shingles shares one of its first n - T + 1 with every partner, T being 3/4
   of n. Those among them that recur are its entries. Most texts have none and end here.
3. Nodes that share an entry may be partners; the components of that relation are the
   clusters within which all links lie. A cluster is searched by one task, or, beyond a
   bound, as pairs of blocks of bounded size, so that nothing is cut off.
4. The search (DivideSkip) takes nodes by size. The inverted lists of a node's shingles
   are divided: the short ones are merged and give the nodes that occur often enough in
   them, and these are looked up in the long ones by binary search. Nodes already known to
   be connected are not compared again.

Shingles are told apart by 48 bits of a hash. Sets never leave the tasks; the driver
handles no more than counts.

Defined cases: a text without words, or null, has an empty set and is linked with
nothing; repeated rows, having equal sets, link; a null doc_id takes part in links and is
never a component's name unless all its ids are null; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import prepare, tidy, tidy_group
from plumbline.llm.components import components
from plumbline.llm.words import mix, shingle_sets
from plumbline.operators.joins import salted_lookup
from plumbline.session import stage

#: Links need 100 * overlap >= PERCENT * union.
PERCENT = 75
#: Bits of a shingle's key. Postings a task sorts at once, texts in them at most, postings of a bucket.
BITS, PORTION, MOST_TEXTS, BUCKET = 48, 2_000_000, 60_000, 2_000_000
#: Nodes of one portion that make a shingle long, and the class of long ones.
LONG, LAST = 32, 255
#: Postings that one task searches at once, about.
CLUSTER = 2_000_000
#: Parts of an entry's list.
PARTS = 16
#: Bytes of text for each shingle, at a guess; only the number of buckets depends on it.
TEXT_BYTES = 6

_NO_ID = np.iinfo(np.int64).min
_ROW = "bucket int, kind int, to int, a binary, b binary, c binary"
_FIELDS = [("bucket", pa.int32()), ("kind", pa.int32()), ("to", pa.int32())] + [(c, pa.binary()) for c in "abc"]
_POSTINGS, _LONG_KEYS, _LONG_POSTINGS, _TEXTS, _NODES = range(5)


def _pack(keys: np.ndarray) -> bytes:
    """Six bytes each, byte by byte: ascending keys then compress well."""
    return keys.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 2:].T.tobytes()


def _unpack(data: bytes) -> np.ndarray:
    n = len(data) // 6
    out = np.zeros((n, 8), dtype=np.uint8)
    out[:, 2:] = np.frombuffer(data, dtype=np.uint8).reshape(6, n).T
    return out.view(">u8").reshape(-1).astype(np.uint64)


def _table(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [[]] * len(_FIELDS)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, _FIELDS)], schema=pa.schema(_FIELDS))


def _owner(nodes: np.ndarray, buckets: int) -> np.ndarray:
    return ((nodes >> np.uint64(20)) % np.uint64(buckets)).astype(np.int64)


def _grouped(by: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(by, kind="stable")
    values, begins = np.unique(by[order], return_index=True)
    for v, part in zip(values.tolist(), np.split(order, begins[1:])):
        yield v, part


class _Portion:
    """Texts of one task until there are enough postings."""

    def __init__(self, buckets: int):
        self.buckets = buckets
        self.clear()

    def clear(self):
        self.place, self.sets, self.texts, self.size = {}, [], [], 0

    def add(self, doc_id: int | None, shingles: np.ndarray) -> None:
        keys = np.unique(shingles >> np.uint64(64 - BITS))
        n = len(keys)
        node = int(mix(np.array([(mix(keys).sum() if n else 0) + np.uint64(n)], dtype=np.uint64))[0])
        self.texts.append((_NO_ID if doc_id is None else doc_id, node, n))
        if n and node not in self.place:
            self.place[node] = len(self.place)
            self.sets.append(keys)
            self.size += n

    def full(self) -> bool:
        return self.size >= PORTION or len(self.texts) >= MOST_TEXTS

    def rows(self) -> Iterator[tuple]:
        buckets = self.buckets
        ids = np.array([t[0] for t in self.texts], dtype=np.int64)
        nodes = np.array([t[1] for t in self.texts], dtype=np.uint64)
        sizes = np.array([t[2] for t in self.texts], dtype=np.uint32)
        for to, at in _grouped(_owner(mix(ids.view(np.uint64)), buckets)):
            yield to, _TEXTS, to, ids[at].tobytes(), nodes[at].tobytes(), sizes[at].tobytes()
        if not self.sets:
            return
        own = np.fromiter(self.place, dtype=np.uint64, count=len(self.place))
        counts = np.array([len(s) for s in self.sets])
        for to, at in _grouped(_owner(own, buckets)):
            yield to, _NODES, to, own[at].tobytes(), counts[at].astype(np.uint32).tobytes(), b""
        keys = np.concatenate(self.sets)
        order = np.argsort(keys, kind="stable")
        keys, place = keys[order], np.repeat(np.arange(len(own)), counts)[order]
        begins = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        runs = np.diff(np.concatenate([begins, [len(keys)]]))
        long = np.repeat(runs >= LONG, runs)
        for to, at in _grouped(_owner(own[place[long]], buckets)):
            yield to, _LONG_POSTINGS, to, _pack(keys[long][at]), own[place[long]][at].tobytes(), b""
        edges = np.array([(b << BITS) // buckets for b in range(1, buckets)], dtype=np.uint64)
        common = keys[begins[runs >= LONG]]
        for bucket, part in enumerate(np.split(common, np.searchsorted(common, edges))):
            if len(part):
                yield bucket, _LONG_KEYS, 0, _pack(part), b"", b""
        keys, place = keys[~long], place[~long]
        cuts = [0, *np.searchsorted(keys, edges).tolist(), len(keys)]
        for bucket, (a, b) in enumerate(zip(cuts, cuts[1:])):
            if b > a:
                used, nth = np.unique(place[a:b], return_inverse=True)
                yield bucket, _POSTINGS, 0, _pack(keys[a:b]), own[used].tobytes(), nth.astype(np.uint16).tobytes()


def _postings_of(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        portion = _Portion(buckets)
        for b in batches:
            for doc_id, shingles in zip(b.column(0).to_pylist(), shingle_sets(b.column(1).to_pylist())):
                portion.add(doc_id, shingles)
                if portion.full():
                    yield _table(list(portion.rows()))
                    portion.clear()
        yield _table(list(portion.rows()))

    return run


def _recurring(buckets: int):
    """A bucket's shingles that occur in several nodes, told to the nodes with their class."""

    def run(group: pa.Table) -> pa.Table:
        keys, nodes, common, out = [], [], [np.empty(0, np.uint64)], []
        for _, kind, to, a, b, c in zip(*(group.column(i).to_pylist() for i in range(6))):
            if kind == _POSTINGS:
                keys.append(_unpack(a))
                nodes.append(np.frombuffer(b, dtype=np.uint64)[np.frombuffer(c, dtype=np.uint16)])
            elif kind == _LONG_KEYS:
                common.append(_unpack(a))
            else:
                out.append((to, kind, to, a, b, c))
        if keys:
            keys, nodes, common = np.concatenate(keys), np.concatenate(nodes), np.unique(np.concatenate(common))
            order = np.argsort(keys, kind="stable")
            keys, nodes = keys[order], nodes[order]
            twin = keys[1:] == keys[:-1]
            several = np.concatenate([[False], twin]) | np.concatenate([twin, [False]])
            if len(common):
                several |= common[np.searchsorted(common, keys).clip(0, len(common) - 1)] == keys
            keys, nodes = keys[several], nodes[several]
            order = np.lexsort((nodes, keys))
            keys, nodes = keys[order], nodes[order]
            new = np.ones(len(keys), dtype=bool)
            new[1:] = (keys[1:] != keys[:-1]) | (nodes[1:] != nodes[:-1])
            keys, nodes = keys[new], nodes[new]
            values, counts = np.unique(keys, return_counts=True)
            rank = np.minimum(counts, LAST - 1)
            rank[np.isin(values, common)] = LAST
            rank = np.repeat(rank, counts).astype(np.uint8)
            keep = rank > 1
            keys, nodes, rank = keys[keep], nodes[keep], rank[keep]
            for to, at in _grouped(_owner(nodes, buckets)):
                out.append((to, _POSTINGS, to, _pack(keys[at]), nodes[at].tobytes(), rank[at].tobytes()))
        return pa.Table.from_batches([_table(out)])

    return run


_ENTRIES = "doc_id long, node long, n int, keys array<long>, entries array<long>"


def _entries(group: pa.Table) -> pa.Table:
    """Texts as they came, and the nodes that have entries with their recurring shingles."""
    texts, sizes, keys, nodes, rank = [], [], [], [], []
    for kind, a, b, c in zip(*(group.column(i).to_pylist() for i in (1, 3, 4, 5))):
        if kind == _TEXTS:
            texts.append((np.frombuffer(a, np.int64), np.frombuffer(b, np.int64), np.frombuffer(c, np.uint32)))
        elif kind == _NODES:
            sizes.append((np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint32)))
        else:
            keys.append(_unpack(a))
            nodes.append(np.frombuffer(b, np.uint64))
            rank.append(np.frombuffer(c, np.uint8) if kind == _POSTINGS else np.full(len(nodes[-1]), LAST, np.uint8))
    rows = []
    if keys:
        size = dict(zip(*(np.concatenate(x).tolist() for x in zip(*sizes))))
        keys, nodes, rank = np.concatenate(keys), np.concatenate(nodes), np.concatenate(rank)
        order = np.lexsort((keys, rank, nodes))
        keys, nodes = keys[order], nodes[order]
        new = np.ones(len(keys), dtype=bool)
        new[1:] = (keys[1:] != keys[:-1]) | (nodes[1:] != nodes[:-1])
        keys, nodes = keys[new].view(np.int64), nodes[new]
        own, begins = np.unique(nodes, return_index=True)
        for node, part in zip(own.tolist(), np.split(keys, begins[1:])):
            n = size[node]
            first = n - -(-PERCENT * n // 100) + 1 - (n - len(part))
            if first > 0:
                rows.append((node, n, np.sort(part), part[:first]))
    ids = np.concatenate([t[0] for t in texts]) if texts else np.empty(0, np.int64)
    text_nodes = np.concatenate([t[1] for t in texts]) if texts else np.empty(0, np.int64)
    text_sizes = np.concatenate([t[2] for t in texts]) if texts else np.empty(0, np.uint32)
    blank = [None] * len(ids)
    return pa.table(
        {
            "doc_id": pa.array(
                [None if i == _NO_ID else i for i in ids.tolist()] + [None] * len(rows), pa.int64()
            ),
            "node": pa.array(
                np.concatenate([text_nodes, np.array([r[0] for r in rows], dtype=np.uint64).view(np.int64)])
            ),
            "n": pa.array(np.concatenate([text_sizes, [r[1] for r in rows]]).astype(np.int32)),
            "keys": pa.array(blank + [r[2] for r in rows], pa.list_(pa.int64())),
            "entries": pa.array(blank + [r[3] for r in rows], pa.list_(pa.int64())),
        }
    )


class Index:
    """Nodes of one or more clusters with their inverted lists, searched by ``links``."""

    def __init__(self, sizes: np.ndarray, sets: list[np.ndarray]):
        self.order = np.argsort(sizes, kind="stable")
        self.sizes = sizes[self.order].astype(np.int64)
        self.sets = [sets[i] for i in self.order]
        lengths = np.array([len(s) for s in self.sets])
        keys = np.concatenate(self.sets)
        by_key = np.argsort(keys, kind="stable")  # ascending ranks within a key
        ranks = np.repeat(np.arange(len(lengths)), lengths)
        self.ranks = ranks[by_key]
        place = np.empty(len(keys), dtype=np.int64)
        place[by_key] = np.arange(len(keys))
        sorted_keys = keys[by_key]
        first = np.searchsorted(sorted_keys, keys)
        bounds = np.cumsum(lengths)[:-1]
        # Each node's lists hold the nodes before it: from the key's first place to its own.
        self.begins, self.ends = np.split(first, bounds), np.split(place, bounds)
        self.parent = np.arange(len(lengths))

    def root(self, x: int) -> int:
        while self.parent[x] != x:
            self.parent[x] = self.parent[self.parent[x]]
            x = self.parent[x]
        return x

    def join(self, a: int, b: int) -> None:
        a, b = self.root(a), self.root(b)
        self.parent[max(a, b)] = min(a, b)

    def linked(self, a: int, b: int) -> bool:
        x, y = self.sets[a], self.sets[b]
        at = np.searchsorted(x, y).clip(0, len(x) - 1)
        overlap = int((x[at] == y).sum())
        return (100 + PERCENT) * overlap >= PERCENT * int(self.sizes[a] + self.sizes[b])

    def occurrences(self, a: int) -> np.ndarray:
        """Nodes before ``a`` that share enough shingles with it."""
        begins, ends = self.begins[a], self.ends[a]
        lengths = ends - begins
        some = lengths > 0
        begins, ends, lengths = begins[some], ends[some], lengths[some]
        n = int(self.sizes[a])
        need = -(-PERCENT * n // 100)
        if len(lengths) < need:
            return np.empty(0, dtype=np.int64)
        order = np.argsort(lengths, kind="stable")
        # DivideSkip: more lists count as long the longer the longest one is.
        long = min(need - 1, int(need / (0.02 * np.log2(lengths[order[-1]] + 1) + 1)))
        short, rest = order[: len(order) - long], order[len(order) - long :]
        merged = np.concatenate([self.ranks[begins[i] : ends[i]] for i in short])
        found, counts = np.unique(merged, return_counts=True)
        fit = (counts >= need - long) & (100 * self.sizes[found] >= PERCENT * n)
        found, counts = found[fit], counts[fit]
        for done, i in enumerate(rest):
            if not len(found):
                break
            line = self.ranks[begins[i] : ends[i]]
            counts = counts + (line[np.searchsorted(line, found).clip(0, len(line) - 1)] == found)
            if done % 16 == 15:
                fit = counts + (long - 1 - done) >= need
                found, counts = found[fit], counts[fit]
        return found[(100 + PERCENT) * counts >= PERCENT * (self.sizes[found] + n)]

    def links(self) -> Iterator[tuple[int, int]]:
        """Pairs that connect what is linked: a spanning forest, by positions as given."""
        members: dict[int, list[int]] = {}  # of parts, some of each
        outside = len(self.sizes)
        big, leaders, others = -1, [], []
        for a in range(len(self.sizes)):
            lead = next((b for b in leaders if self.linked(a, b)), -1) if big >= 0 else -1
            if lead >= 0:
                self.join(a, lead)
                yield int(self.order[a]), int(self.order[lead])
                rest = [b for b in others if self.root(b) != self.root(a)]
                partners = [b for b in rest if self.linked(a, b)] if len(rest) <= 32 else self.occurrences(a).tolist()
            else:
                partners = self.occurrences(a).tolist()
            for b in partners:
                if self.root(a) != self.root(b):
                    self.join(a, b)
                    yield int(self.order[a]), int(self.order[b])
            if big < 0 and partners:
                big, leaders = a, [a]
            if big >= 0 and self.root(a) == self.root(big):
                if len(leaders) < 4 and lead < 0 and a != leaders[-1]:
                    leaders.append(a)
            else:
                others.append(a)
            if len(others) > 64:
                others = [b for b in others if self.root(b) != self.root(big)] if big >= 0 else others


def _search(group: pa.Table) -> pa.Table:
    """Links within the clusters of a group."""
    a, b = [], []
    clusters = group.column("cluster").to_numpy()
    nodes, sizes = group.column("node").to_numpy(), group.column("n").to_numpy()
    lists = group.column("keys").combine_chunks()
    flat, bounds = lists.flatten().to_numpy(), np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())])
    for _, at in _grouped(clusters):
        if len(at) > 1:
            index = Index(sizes[at], [flat[bounds[i] : bounds[i + 1]] for i in at])
            for x, y in index.links():
                a.append(nodes[at[x]])
                b.append(nodes[at[y]])
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def similar(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id, n_shingles and component_id, the smallest doc_id reachable by links, of every row."""
    spark = docs.sparkSession
    prepare(spark)
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(1, -(-size // (TEXT_BYTES * BUCKET)))
    told = (
        rows.mapInArrow(tidy(_postings_of(buckets)), _ROW)
        .groupBy("bucket")
        .applyInArrow(tidy_group(_recurring(buckets)), _ROW)
        .groupBy("to")
        .applyInArrow(tidy_group(_entries), _ENTRIES)
    )
    told = stage(told, "ngram_entries")
    texts = told.where("keys is null").select("doc_id", "node", F.col("n").alias("n_shingles"))
    sets = told.where("keys is not null")
    entries = sets.select("node", F.explode("entries").alias("key"))
    # Nodes of one entry are tied to the least of their part of its list, and these to each
    # other: an entry of very many nodes meets in parts only.
    part = F.pmod(F.xxhash64("node"), F.lit(PARTS))
    low = F.min("node").over(Window.partitionBy("key", part))
    parts = entries.select("key", "node", low.alias("low"))
    lows = parts.select("key", "low").distinct()
    lows = lows.select(F.min("low").over(Window.partitionBy("key")).alias("a"), F.col("low").alias("b"))
    clusters = components(parts.select(F.col("low").alias("a"), F.col("node").alias("b")).unionAll(lows))
    sizes = sets.select("node", F.size("keys").alias("size")).join(
        clusters.withColumnRenamed("component", "cluster"), "node"
    )
    sizes = stage(sizes, "ngram_members")
    weights = stage(sizes.groupBy("cluster").agg(F.sum("size").alias("postings")), "ngram_weights")
    tasks = max(1, -(-(weights.agg(F.sum("postings")).first()[0] or 0) // CLUSTER))
    members = salted_lookup(sizes.drop("size"), weights, "cluster", "node")
    members = members.withColumn("blocks", F.ceil(F.col("postings") / F.lit(CLUSTER // 2)).cast("int"))
    # Clusters up to the bound share tasks; a larger one is searched as pairs of its blocks.
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.when(F.col("postings") > CLUSTER, F.col("blocks") - 1).otherwise(0)))
    dealt = members.select("*", own.alias("own")).select("*", other.alias("other"))
    pair = F.when(
        F.col("postings") > CLUSTER,
        F.concat_ws(":", "cluster", F.least("own", "other").cast("string"), F.greatest("own", "other").cast("string")),
    ).otherwise(F.pmod(F.xxhash64("cluster"), F.lit(tasks)).cast("string"))
    links = (
        dealt.select(pair.alias("task"), "cluster", "node")
        .join(sets.select("node", "n", "keys").hint("merge"), "node")
        .groupBy("task")
        .applyInArrow(tidy_group(_search), "a long, b long")
    )
    found = components(links)
    ids = texts.groupBy("node").agg(F.min("doc_id").alias("least"))
    named = ids.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    named = stage(named.join(least, "component").select("node", "component_id"), "ngram_names")
    # A node of very many copies is split by the adaptive skew join.
    return texts.join(named.hint("merge"), "node").select(
        "doc_id",
        F.col("n_shingles").cast("long").alias("n_shingles"),
        F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"),
    )
