"""Decision trees per view from class counts in cells (M2, the second scorer).

Edges are exact quantiles of the train rows, so that every feature has at most ``BINS``
cells and one for missing values. Train rows are stored once as cells. A level of all trees
is one aggregate: class counts per (view, node, feature, cell), shrunk by every task before
the shuffle to at most views x nodes x features x cells rows, whatever the input. Splits are
picked from these counts; rows find their node by looking the splits up, by its number, as they are read.

Defined cases: a missing value lies below all edges; a view without any value trains
nothing and has no score; a node splits while both sides keep ``MIN_ROWS`` rows and the
classes get purer; ties go to the earlier feature, then to the lower cell; a leaf's score
is (positives + 1) / (rows + 2).
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.scalars import long_features, with_scalar
from plumbline.operators.ranking import exact_quantiles
from plumbline.session import stage
from plumbline.spec import ViewSpec

BINS, DEPTH, MIN_ROWS = 16, 3, 20
# Least gain of a split, in rows; below it is rounding.
MIN_GAIN = 1e-6


def fit_edges(train: DataFrame, spec: ViewSpec, bins: int = BINS) -> DataFrame:
    """``feature``, ``edges``: the inner quantiles of each feature, ascending."""
    probs = {f"e{k}": k / bins for k in range(1, bins)}
    found = exact_quantiles(long_features(train, spec.features, []), ["_f"], "_x", probs)
    names = F.array(*[F.lit(f) for f in spec.features])
    return found.select(F.element_at(names, F.col("_f") + 1).alias("feature"), F.array(*probs).alias("edges"))


def _cell(feature: str) -> Column:
    """0 for a missing value, else one more than the edges below it."""
    edges = F.coalesce(F.try_element_at("_E", F.lit(feature)), F.array().cast("array<double>"))
    below = F.size(F.filter(edges, lambda e: e < F.col(feature)))
    return F.when(F.col(feature).isNull(), F.lit(0)).otherwise(below + 1)


def _seen(spec: ViewSpec, view: str, missing: Callable[[str], Column]) -> Column:
    return ~reduce(lambda a, b: a & b, [missing(f) for f in spec.views[view]])


def _down(df: DataFrame, spec: ViewSpec, levels: int, right: Callable[[str, Column], Column]) -> DataFrame:
    """Adds ``_n_<view>``: the node of a row's view after ``levels`` splits of the table ``_T``."""
    df = df.withColumns({f"_n_{v}": F.lit(1) for v in spec.names})
    split = {v: F.get(F.col("_T").getField(v), F.col(f"_n_{v}")) for v in spec.names}
    for _ in range(levels):
        df = df.withColumns({f"_s_{v}": split[v] for v in spec.names})
        df = df.withColumns(
            {
                f"_n_{v}": F.when(F.col(f"_s_{v}.f").isNull(), F.col(f"_n_{v}")).otherwise(
                    F.col(f"_n_{v}") * 2 + right(v, F.col(f"_s_{v}")).cast("int")
                )
                for v in spec.names
            }
        )
    return df.drop(*[f"_s_{v}" for v in spec.names])


def _by_node(nodes: DataFrame, spec: ViewSpec, levels: int, *values: Column | str) -> DataFrame:
    """One row: an array per view of the values of its nodes down to ``levels`` splits, by their number."""
    key = lambda view, node: F.concat_ws(":", view, node.cast("string"))
    pairs = F.collect_list(F.struct(key(F.col("view"), F.col("node")).alias("key"), F.struct(*values).alias("value")))
    numbers = F.sequence(F.lit(0), F.lit(2 ** (levels + 1) - 1))
    of = lambda v: F.transform(numbers, lambda n: F.try_element_at("_m", key(F.lit(v), n)))
    one = nodes.agg(F.map_from_entries(pairs).alias("_m"))
    return one.select(F.struct(*[of(v).alias(v) for v in spec.names]).alias("t"))


def _best_splits(counts: DataFrame, min_rows: int) -> DataFrame:
    """Nodes with their counts and, where one is worth it, the best split (``f``, ``cut``)."""
    feature = Window.partitionBy("view", "node", "f")
    upward = feature.orderBy("cell")
    d = lambda c: F.col(c).cast("double")
    tried = counts.select(
        "view", "node", "f", F.col("cell").alias("cut"),
        F.sum("n").over(feature).alias("n"), F.sum("p").over(feature).alias("p"),
        F.sum("n").over(upward).alias("nl"), F.sum("p").over(upward).alias("pl"),
    ).withColumns({"nr": F.col("n") - F.col("nl"), "pr": F.col("p") - F.col("pl")})
    purer = d("pl") * d("pl") / d("nl") + F.try_divide(d("pr") * d("pr"), d("nr")) - d("p") * d("p") / d("n")
    allowed = (F.col("nl") >= min_rows) & (F.col("nr") >= min_rows) & (purer > MIN_GAIN)
    tried = tried.withColumn("gain", F.when(allowed, purer))
    best = F.min_by(
        F.struct("gain", "f", "cut", "nl", "pl"),
        F.struct(F.col("gain").isNull(), -F.col("gain"), F.col("f"), F.col("cut")),
    )
    nodes = tried.groupBy("view", "node").agg(F.max("n").alias("n"), F.max("p").alias("p"), best.alias("b"))
    chosen = lambda c: F.when(F.col("b.gain").isNotNull(), F.col(f"b.{c}")).alias(c)
    return nodes.select("view", "node", "n", "p", *[chosen(c) for c in ("f", "cut", "gain", "nl", "pl")])


def fit_trees(
    train: DataFrame, spec: ViewSpec, y: str = "y", bins: int = BINS, depth: int = DEPTH, min_rows: int = MIN_ROWS
) -> DataFrame:
    """One row per node of every view's tree: ``view``, ``node`` (children 2n and 2n + 1), ``n``, ``p``
    (rows and positives), ``feature``, ``threshold`` (at most goes left; null: only missing values do),
    ``gain``, ``score``; a leaf has no feature. Pass rows of the training split only.

    The table has at most views x 2^(depth + 1) rows.
    """
    train = train.where(F.col(y).isNotNull())
    edges = stage(fit_edges(train, spec, bins), "tree_edges")
    table = edges.agg(F.map_from_entries(F.collect_list(F.struct("feature", "edges"))).alias("m"))
    cells = train.withColumn("_E", table.scalar())
    cells = stage(
        cells.select(F.col(y).cast("int").alias("y"), *[_cell(f).cast("byte").alias(f) for f in spec.features]),
        "tree_cells",
    )
    done = None
    for level in range(depth):
        rows = cells
        if done is not None:
            rows = rows.withColumn("_T", _by_node(done.where("f is not null"), spec, level, "f", "cut").scalar())
        rows = _down(rows, spec, level, lambda v, s: F.get(F.array(*spec.views[v]), s["f"]) > s["cut"])
        parts = F.array(
            *[
                F.struct(
                    F.lit(v).alias("view"),
                    F.when(_seen(spec, v, lambda f: F.col(f) == 0), F.col(f"_n_{v}")).alias("node"),
                    F.lit(j).alias("f"),
                    F.col(f).cast("int").alias("cell"),
                )
                for v, fs in spec.views.items()
                for j, f in enumerate(fs)
            ]
        )
        counts = (
            rows.select("y", F.inline(parts))
            .where(F.col("node") >= 2**level)
            .groupBy("view", "node", "f", "cell")
            .agg(F.count("*").alias("n"), F.sum("y").alias("p"))
        )
        found = stage(_best_splits(counts, min_rows), "tree_level")
        done = found if done is None else done.unionByName(found)
    # Leaves of the last level: the two sides of the splits above them.
    last = done.where((F.col("node") >= 2 ** (depth - 1)) & F.col("f").isNotNull())
    side = lambda right, n, p: F.struct((F.col("node") * 2 + right).alias("node"), n.alias("n"), p.alias("p"))
    sides = F.array(
        side(0, F.col("nl"), F.col("pl")), side(1, F.col("n") - F.col("nl"), F.col("p") - F.col("pl"))
    )
    leaves = last.select("view", F.inline(sides))
    nodes = done.unionByName(leaves, allowMissingColumns=True)
    feature = F.coalesce(
        *[F.when((F.col("view") == v) & (F.col("f") == j), F.lit(f)) for v, fs in spec.views.items() for j, f in enumerate(fs)]
    )
    nodes = nodes.withColumn("feature", feature).withColumn("_E", table.scalar())
    return nodes.select(
        "view", "node", "n", "p", "f", "feature",
        F.get(F.col("_E")[F.col("feature")], F.col("cut") - 1).alias("threshold"),
        "gain",
        ((F.col("p") + 1).cast("double") / (F.col("n") + 2).cast("double")).alias("score"),
    )


def score_views(df: DataFrame, spec: ViewSpec, trees: DataFrame, depth: int = DEPTH) -> DataFrame:
    """Adds ``p_<view>``: the score of the leaf a record falls into; null if the view has no value."""

    def right(v: str, split: Column) -> Column:
        x = F.get(F.array(*spec.views[v]), split["f"])
        return F.coalesce(x.isNotNull() & (split["threshold"].isNull() | (x > split["threshold"])), F.lit(False))

    df = df.withColumn("_T", _by_node(trees, spec, depth, "f", "threshold", "score").scalar())
    df = _down(df, spec, depth, right)
    leaf = lambda v: F.get(F.col("_T").getField(v), F.col(f"_n_{v}"))["score"]
    scores = {f"p_{v}": F.when(_seen(spec, v, lambda f: F.col(f).isNull()), leaf(v)) for v in spec.names}
    return df.withColumns(scores).drop("_T", *[f"_n_{v}" for v in spec.names])
