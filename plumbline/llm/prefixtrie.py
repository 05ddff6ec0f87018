"""Conversation prefix trie: subtree totals by parallel tree contraction.

Every sequence of turns that some conversation starts with is a node of the trie; equal
sequences are one node. Totals over all subtrees (childless nodes, tokens saved by sharing)
come from contraction rounds of joins:

- compress: in a chain of nodes with a single child each, all but the top are taken out; each
  remembers the sum of its chain from itself down, and the node below the chain;
- rake: leaves are taken out, their totals are final and are added to their parents.

Rounds end when the root is alone; their number grows with the logarithm of the trie's size.
Then the rounds are undone from the last to the first: a node taken out of a chain has the sum
it remembers plus the total of the node below.

A chain's nodes all have the same longest member (ties: the smallest name), which names the
path the chain lies on; runs are found in windows of CELL depths of one path, so that a long
conversation is never one task's. A turn's place in its conversation is counted by range
partitions of the sorted table and the sizes of the partitions before. A sequence's name is the
exclusive or of two 64-bit hashes of (place, role, text) over its turns. Lists of members are
hashed in pieces of CELL names; only a node with several pieces is put together by a Python
function, which streams the pieces through SHA-256 one after the other.

Defined cases: null roles and texts are empty; turns are ordered by (turn, role, text), a null
turn first, and repeated rows are turns of their own; rows without a conv_id belong to no
conversation; a conversation may be left without turns and is then a member of the root only;
without conversations there are no nodes; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import prepare
from plumbline.session import stage

#: Depths of a window, and names of a piece of a list.
CELL = 4096
#: Conversations that share an opening, and most turns of it.
SPAN, TURNS = 20, 4

_NODE = ["conv", "depth"]


def _placed(turns: DataFrame) -> DataFrame:
    """``turns`` with ``at``, the number of each within its conversation from 1."""
    order = ["conv", "turn", "role", "text"]
    # Staged, as the partition's number is part of the row; sorting is by the whole row, so a
    # conversation of any length is spread over many partitions.
    ranged = stage(
        turns.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "trie_turns"
    )
    sizes = ranged.groupBy("conv", "part").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    before = stage(sizes.select("conv", "part", before.alias("before")), "trie_parts")
    nth = F.row_number().over(Window.partitionBy("conv", "part").orderBy("turn", "role", "text"))
    return ranged.withColumn("nth", nth).join(before, ["conv", "part"]).withColumn("at", F.col("nth") + F.col("before")).drop("nth", "before", "part")


def rebuilt(conversations: DataFrame, span: int = SPAN, turns: int = TURNS) -> tuple[DataFrame, DataFrame]:
    """(conv, at, role, text) of every rebuilt turn, and all conv.

    A conversation takes the first h turns of the first one of its span, h being the CRC of its
    name modulo ``turns``, and then its own turns after its first h.
    """
    rows = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv"),
        "turn",
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    placed = stage(_placed(rows), "trie_placed")
    opening = F.crc32(F.col("conv").cast("string").cast("binary")) % F.lit(turns)
    base = F.col("conv") - F.col("conv") % F.lit(span)
    known = placed.where("at = 1").select("conv", opening.alias("h"), base.alias("base"))
    heads = placed.where(F.col("at") < turns).select(F.col("conv").alias("base"), "at", "role", "text")
    taken = known.join(heads, "base").where(F.col("at") <= F.col("h")).select("conv", "at", "role", "text")
    sizes = heads.groupBy("base").agg(F.max("at").alias("size"))
    shift = known.join(sizes, "base", "left").select(
        "conv", "h", (F.least(F.coalesce("size", F.lit(0)), "h") - F.col("h")).alias("shift")
    )
    own = placed.join(shift, "conv").where(F.col("at") > F.col("h"))
    own = own.select("conv", (F.col("at") + F.col("shift")).alias("at"), "role", "text")
    return taken.unionByName(own), known.select("conv")


def _running_xor(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Running exclusive or of ``columns`` along each conversation, in cells of CELL turns."""
    rows = rows.withColumn("cell", F.floor((F.col("at") - 1) / F.lit(CELL)))
    whole = rows.groupBy("conv", "cell").agg(*(F.bit_xor(c).alias(f"all_{c}") for c in columns))
    past = Window.partitionBy("conv").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    past = whole.select("conv", "cell", *(F.coalesce(F.bit_xor(f"all_{c}").over(past), F.lit(0)).alias(f"past_{c}") for c in columns))
    upto = Window.partitionBy("conv", "cell").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({f"upto_{c}": F.bit_xor(c).over(upto) for c in columns}).join(past, ["conv", "cell"])
    return rows.withColumns({f"name_{c}": F.col(f"upto_{c}").bitwiseXOR(F.col(f"past_{c}")) for c in columns})


def words(text: str | Column) -> Column:
    return F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+"))


def trie(turns: DataFrame, convs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and members.

    Nodes: conv and depth (name), parent_conv, deep (longest member), n_convs, saved (of the node
    itself), names ``x`` and ``y``. Members that end in a node: conv, depth, x, y of the node and
    ``member``. The root has depth 0.
    """
    hashes = {c: F.xxhash64(F.lit(c), "at", "role", "text") for c in ("x", "y")}
    steps = _running_xor(turns.withColumns(hashes).withColumn("words", words("text")).drop("role", "text"), list(hashes))
    lengths = turns.groupBy("conv").agg(F.max("at").alias("length"))
    lengths = stage(convs.join(lengths, "conv", "left").na.fill(0, ["length"]), "trie_lengths")
    steps = steps.join(lengths, "conv").select(
        "conv",
        "length",
        F.col("at").alias("depth"),
        F.col("name_x").alias("x"),
        F.col("name_y").alias("y"),
        F.col("name_x").bitwiseXOR(F.col("x")).alias("px"),
        F.col("name_y").bitwiseXOR(F.col("y")).alias("py"),
        "words",
    )
    start = lengths.select("conv", "length", *(F.lit(0).cast("long").alias(c) for c in ("depth", "x", "y", "px", "py", "words")))
    steps = stage(steps.select(start.columns).unionByName(start), "trie_steps")
    nodes = steps.groupBy("depth", "x", "y").agg(
        F.min("conv").alias("conv"),
        F.count("*").alias("n_convs"),
        F.min(F.struct((-F.col("length")).alias("length"), "conv"))["conv"].alias("deep"),
        F.min("px").alias("px"),
        F.min("py").alias("py"),
        ((F.count("*") - 1) * F.max("words")).cast("long").alias("saved"),
    )
    nodes = stage(nodes, "trie_names")
    above = nodes.select((F.col("depth") + 1).alias("depth"), F.col("x").alias("px"), F.col("y").alias("py"), F.col("conv").alias("parent_conv"))
    nodes = stage(nodes.join(above, ["depth", "px", "py"], "left").drop("px", "py"), "trie_nodes")
    ends = steps.where("depth = length").select("depth", "x", "y", F.col("conv").alias("member"))
    return nodes, ends


def _contract(nodes: DataFrame, values: list[str]) -> tuple[list[DataFrame], DataFrame]:
    """Rounds of nodes taken out (conv, depth, values, below_conv, below_depth; below null: final),
    and the root with its totals."""
    alive = nodes.select(*_NODE, "deep", "parent_conv", (F.col("depth") - 1).alias("parent_depth"), *values)
    rounds = []
    while True:
        kids = alive.where("depth > 0").groupBy(F.col("parent_conv").alias("conv"), F.col("parent_depth").alias("depth")).agg(
            F.count("*").alias("kids"), F.min(F.struct(*_NODE)).alias("kid")
        )
        tree = stage(alive.join(kids, _NODE, "left").na.fill(0, ["kids"]), "trie_tree")
        if not rounds and tree.isEmpty() or tree.where("depth > 0").isEmpty():
            return rounds, tree.select(*_NODE, *values)
        # Compress: runs of single children on one path, in windows of CELL depths.
        cell = Window.partitionBy("deep", F.floor(F.col("depth") / F.lit(CELL))).orderBy("depth")
        chain = tree.where("kids = 1 and depth > 0")
        begins = ~F.coalesce(F.lag("kid").over(cell) == F.struct(*_NODE), F.lit(False))
        chain = chain.withColumn("run", F.struct("deep", F.max(F.when(begins, F.col("depth"))).over(cell).alias("top")))
        down = Window.partitionBy("run").orderBy(F.desc("depth"))
        last = F.first("kid").over(down)
        sums = {v: F.sum(v).over(down) for v in values}
        chain = chain.select(*_NODE, "deep", "parent_conv", "parent_depth", last.alias("below"), (F.col("depth") == F.col("run.top")).alias("top"), *(s.alias(v) for v, s in sums.items()))
        chain = stage(chain, "trie_chain")
        out = chain.where("not top").select(*_NODE, *values, F.col("below.conv").alias("below_conv"), F.col("below.depth").alias("below_depth"))
        kept = tree.where("kids <> 1 or depth = 0").select(*_NODE, "deep", "parent_conv", "parent_depth", *values, "kids")
        tops = chain.where("top").select(*_NODE, "deep", "parent_conv", "parent_depth", *values, F.lit(1).cast("long").alias("kids"))
        kept = kept.unionByName(tops)
        # What hung below a chain hangs on its top now.
        moved = chain.where("top").select(F.col("below.conv").alias("conv"), F.col("below.depth").alias("depth"), F.struct(*_NODE).alias("to"))
        kept = kept.join(moved, _NODE, "left").withColumns(
            {"parent_conv": F.coalesce("to.conv", "parent_conv"), "parent_depth": F.coalesce("to.depth", "parent_depth")}
        )
        kept = stage(kept.drop("to"), "trie_kept")
        # Rake.
        leaf = (F.col("kids") == 0) & (F.col("depth") > 0)
        final = [F.lit(None).cast("long").alias(f"below_{c}") for c in _NODE]
        rounds.append(out.unionByName(kept.where(leaf).select(*_NODE, *values, *final)))
        more = kept.where(leaf).groupBy(F.col("parent_conv").alias("conv"), F.col("parent_depth").alias("depth")).agg(
            *(F.sum(v).alias(f"more_{v}") for v in values)
        )
        alive = kept.where(~leaf).drop("kids").join(more, _NODE, "left")
        alive = alive.withColumns({v: F.col(v) + F.coalesce(f"more_{v}", F.lit(0)) for v in values})
        alive = alive.drop(*(f"more_{v}" for v in values))


def subtree_sums(nodes: DataFrame, values: list[str]) -> DataFrame:
    """conv, depth and the sums of ``values`` over each node's subtree."""
    rounds, totals = _contract(nodes, values)
    for out in reversed(rounds):
        # Leaves come first: a chain may hang above one that was raked in the same round.
        totals = totals.unionByName(out.where("below_conv is null").select(totals.columns))
        below = totals.select(F.col("conv").alias("below_conv"), F.col("depth").alias("below_depth"), *(F.col(v).alias(f"below_{v}") for v in values))
        done = out.where("below_conv is not null").join(below, ["below_conv", "below_depth"])
        done = done.select(*_NODE, *((F.col(v) + F.col(f"below_{v}")).alias(v) for v in values))
        totals = stage(totals.unionByName(done), "trie_totals")
    return totals


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the pieces of each node, which come one after the other."""
    node, state = None, None
    for b in batches:
        done = []
        for *own, piece in zip(*(c.to_pylist() for c in b.columns)):
            if own != node:
                if node:
                    done.append((*node, state.hexdigest()))
                node, state = own, hashlib.sha256(piece.encode())
            else:
                state.update(b"," + piece.encode())
        yield _digests(done)
    if node:
        yield _digests([(*node, state.hexdigest())])


def _digests(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [[]] * 4
    return pa.RecordBatch.from_arrays(
        [pa.array(c, pa.int64()) for c in columns[:3]] + [pa.array(columns[3], pa.string())], ["depth", "x", "y", "sha256"]
    )


def end_digests(ends: DataFrame) -> DataFrame:
    """depth, x, y and sha256 of the ascending names of the members that end there."""
    key = ["depth", "x", "y"]
    pieces = ends.groupBy(*key, F.floor(F.col("member") / F.lit(CELL)).alias("nth")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list("member")), lambda m: m.cast("string")), ",").alias("piece")
    )
    pieces = stage(pieces, "trie_pieces")
    counts = pieces.groupBy(*key).agg(F.count("*").alias("pieces"), F.min("piece").alias("only"))
    counts = stage(counts, "trie_counts")
    single = counts.where("pieces = 1").select(*key, F.sha2("only", 256).alias("sha256"))
    several = pieces.join(counts.where("pieces > 1").select(*key), key).repartition(*key).sortWithinPartitions(*key, "nth")
    several = several.select(*key, "piece").mapInArrow(_digest, "depth long, x long, y long, sha256 string")
    return single.unionByName(several)


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    prepare(conversations.sparkSession)
    turns, convs = rebuilt(conversations)
    nodes, ends = trie(stage(turns, "trie_rebuilt"), stage(convs, "trie_convs"))
    children = nodes.where("depth > 0").groupBy(F.col("parent_conv").alias("conv"), (F.col("depth") - 1).alias("depth")).agg(
        F.count("*").alias("n_children")
    )
    nodes = stage(nodes.join(children, _NODE, "left").na.fill(0, ["n_children"]), "trie_children")
    leaves = F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long")
    totals = subtree_sums(nodes.withColumn("leaves", leaves), ["leaves", "saved"])
    nodes = nodes.drop("saved").join(totals, _NODE).join(end_digests(ends), ["depth", "x", "y"], "left")
    return nodes.select(
        F.col("conv").alias("conv_id"),
        F.col("depth").cast("long").alias("depth"),
        F.col("parent_conv").alias("parent_conv_id"),
        "n_convs",
        "n_children",
        F.col("leaves").alias("n_leaves"),
        F.col("saved").alias("saved_tokens"),
        F.coalesce("sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
    )
