"""Mixing sources to target weights: weighted sampling by exponential keys.

Each document gets the key ``-ln(u) / w``, where ``u`` is a hash of seed and document
and ``w`` its quality weight (Efraimidis and Spirakis). A source whose target is
``e`` whole epochs and a fraction gives every document ``e`` times and, once more, the
documents with the smallest keys whose sizes add up to the fraction.

Only sums cross the network before the cut is known: sizes per (source, cell), a cell
being a range of keys. A source's cut falls into one cell; rows of the cells before it
are taken, rows of later ones are not, and only the rows of that one cell are ordered.

Defined cases: a null text has size 0; a null source is a source of its own, the last;
a null or non-positive quality weight counts as 1; repeated rows have equal keys, and of
those at the cut as many are taken as fit; sources of size 0 get target 0 and no epochs;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import prepare
from plumbline.operators.joins import salted_lookup
from plumbline.session import stage

#: Words are runs without ASCII white space; weights repeat over the sources.
WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
#: No source is taken more often than this.
MOST_EPOCHS = 3
#: Ranges of keys for each source; the rows of one are put in order. With 10**10 rows in a source they are some 2 million.
CELLS = 4096
SEED = "mix-1"


def size_in_words(text) -> F.Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def uniform(seed: str, key) -> F.Column:
    """In (0, 1): the first 52 bits of a digest of seed and key."""
    head = F.substring(F.md5(F.concat_ws("|", F.lit(seed), F.coalesce(key.cast("string"), F.lit("")))), 1, 13)
    return (F.conv(head, 16, 10).cast("double") + F.lit(0.5)) / F.lit(float(2**52))


def targets(sources: DataFrame, weights=WEIGHTS, most: float = MOST_EPOCHS) -> DataFrame:
    """Adds ``target`` to one row per source (``name``, ``source_size``).

    Shares of the total by weight, none above ``most`` times its size; what is cut off is
    shared by weight among the rest. A source is capped when ``size / weight`` is at most
    a level; sorting by that ratio gives the level by two running sums. One row per
    source, so this is the one place with a window over a whole table.
    """
    by_name = Window.orderBy(F.col("name").isNull(), "name")
    listed = F.array(*[F.lit(float(w)) for w in weights])
    s = sources.withColumn("nth", F.row_number().over(by_name) - 1)
    s = s.withColumn("weight", F.get(listed, F.pmod("nth", F.lit(len(weights))).cast("int")))
    s = s.withColumns(
        {
            "cap": F.col("source_size") * F.lit(float(most)),
            "total": F.sum("source_size").over(Window.partitionBy()).cast("double"),
        }
    )
    before = Window.orderBy(F.col("cap") / F.col("weight"), "nth").rowsBetween(Window.unboundedPreceding, -1)
    onward = Window.orderBy(F.col("cap") / F.col("weight"), "nth").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    s = s.withColumns(
        {
            "rest": F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0)),
            "share": F.sum("weight").over(onward),
        }
    )
    # The first source that its share of the rest does not fill sets the level for all after it.
    s = s.withColumn("level", F.col("rest") / F.col("share"))
    open_ = F.col("cap") > F.col("weight") * F.col("level")
    level = F.min_by(F.when(open_, F.col("level")), F.when(open_, F.col("cap") / F.col("weight"))).over(Window.partitionBy())
    target = F.least(F.col("cap"), F.col("weight") * level)
    return s.withColumn("target", F.coalesce(target, F.col("cap"))).select("name", "source_size", "target")


def mix(
    docs: DataFrame,
    quality: DataFrame | None = None,
    key: str = "doc_id",
    text: str = "text",
    source: str = "source",
    seed: str = SEED,
    weights=WEIGHTS,
    most: float = MOST_EPOCHS,
) -> DataFrame:
    """One row per row of ``docs``: doc_id, source, size, source_size, target, epochs, copies, taken.

    ``quality`` has columns ``doc_id`` and ``weight``, the sampling weight of a document
    within its source; without a row there the weight is 1. ``copies`` is how often the
    document is taken, ``taken`` its words times that. A source's documents are taken as
    far as the cut comes nearest to its target.
    """
    prepare(docs.sparkSession)
    rows = docs.select(
        F.col(key).alias("doc_id"), F.col(source).alias("name"), size_in_words(F.col(text)).alias("size")
    )
    weight = F.lit(1.0)
    if quality is not None:
        per_doc = quality.groupBy("doc_id").agg(F.max("weight").alias("w"))
        rows = rows.join(per_doc, "doc_id", "left")
        weight = F.when(F.col("w") > 0, F.col("w").cast("double")).otherwise(1.0)
    order = -F.log(uniform(seed, F.col("doc_id"))) / weight
    cell = F.floor((F.lit(1.0) - F.exp(-order)) * F.lit(CELLS)).cast("int")
    # A null name cannot be a join key, so sources are joined by a name that is never null.
    tag = F.when(F.col("name").isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), F.col("name")))
    rows = stage(
        rows.withColumns({"order": order, "tag": tag}).select(
            "doc_id", "name", "tag", "size", "order", F.least(cell, F.lit(CELLS - 1)).alias("cell")
        ),
        "mix_rows",
    )
    cells = stage(
        rows.groupBy("tag", "cell").agg(F.first("name").alias("name"), F.sum("size").alias("size")), "mix_cells"
    )
    sources = cells.groupBy("tag").agg(F.first("name").alias("name"), F.sum("size").alias("source_size"))
    sources = targets(sources, weights, most).withColumn(
        "tag", F.when(F.col("name").isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), F.col("name")))
    )
    epochs = F.floor(F.try_divide("target", "source_size"))
    sources = sources.select(
        "tag",
        "source_size",
        "target",
        F.coalesce(epochs, F.lit(0)).alias("epochs"),
        F.coalesce(F.col("target") - epochs * F.col("source_size"), F.lit(0.0)).alias("rest"),
    )
    running = Window.partitionBy("tag").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    begins = cells.select(
        "tag", "cell", "size", F.coalesce(F.sum("size").over(running), F.lit(0)).alias("begin")
    ).join(sources.select("tag", "rest"), "tag")
    cut = begins.where((F.col("begin") <= F.col("rest")) & (F.col("rest") < F.col("begin") + F.col("size")))
    plan = stage(
        sources.join(cut.select("tag", F.col("cell").alias("cut"), "begin"), "tag", "left").withColumns(
            {"cut": F.coalesce("cut", F.lit(-1)), "begin": F.coalesce("begin", F.lit(0))}
        ),
        "mix_plan",
    )
    r = salted_lookup(rows, plan, "tag", "doc_id")
    ordered = Window.partitionBy("tag", "cell").orderBy("order", "doc_id", "size")
    at_cut = r.where(F.col("cell") == F.col("cut")).withColumn(
        "end", F.col("begin") + F.sum("size").over(ordered.rowsBetween(Window.unboundedPreceding, 0))
    )
    # Up to the document at the cut, which is taken if that comes nearer to the target.
    once_more = (F.col("end") <= F.col("rest")) | (
        (F.col("end") - F.col("size") < F.col("rest"))
        & (F.col("end") - F.col("rest") < F.col("rest") - F.col("end") + F.col("size"))
    )
    at_cut = at_cut.withColumn("more", once_more.cast("long")).drop("end")
    others = r.where(F.col("cell") != F.col("cut")).withColumn("more", (F.col("cell") < F.col("cut")).cast("long"))
    copies = F.col("epochs") + F.col("more")
    return others.unionByName(at_cut).select(
        "doc_id",
        F.col("name").alias("source"),
        "size",
        F.col("source_size").cast("long").alias("source_size"),
        "target",
        "epochs",
        copies.alias("copies"),
        (F.col("size") * copies).alias("taken"),
    )


def take(docs: DataFrame, mixed: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs``, each as often as ``mixed`` takes it.

    Repeated rows (one doc_id and size) are taken alike: each as often as they are taken
    on average, rounded.
    """
    copies = mixed.groupBy("doc_id", "size").agg(F.round(F.avg("copies")).cast("int").alias("copies"))
    m, d = copies.where("copies > 0").alias("m"), docs.alias("d")
    same = F.col(f"d.{key}").eqNullSafe(F.col("m.doc_id")) & (size_in_words(F.col(f"d.{text}")) == F.col("m.size"))
    taken = d.join(m.hint("merge"), same).select(
        F.struct(*[F.col(f"d.`{c}`") for c in docs.columns]).alias("_row"),
        F.explode(F.array_repeat(F.lit(1), F.col("m.copies"))).alias("_one"),
    )
    return taken.select("_row.*")
