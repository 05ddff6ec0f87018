"""Partitions and folds that keep an entity's records together.

Only counts per entity and class are assigned. Entities with a large share of the records,
of which there can be few, are placed one after the other, larger ones first, each in the
part that lacks most of its classes. All others are placed by running sums of their sizes:
inside a stratum of one leading class and one order of size, in an order given by a hash,
each part takes a stretch as long as it still lacks. The running sums are chained over cells
of hash prefixes, so that no task reads a whole stratum, and records meet their entity's part
in a salted lookup.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.scalars import keyed_md5, with_scalar
from plumbline.operators.joins import salted_lookup
from plumbline.operators.splits import SEED
from plumbline.session import stage

# An entity is placed by itself if it has at least this part of all records.
MOST_LARGE = 150
# Shares of train, validation and test.
SHARES = (0.6, 0.2, 0.2)
NAMES = ("train", "validation", "test")


def group_id(entity: str, key: str) -> Column:
    """An entity's records are one group; a record without an entity is one by itself."""
    return F.coalesce(
        F.concat(F.lit("entity:"), F.col(entity).cast("string")), F.concat(F.lit("record:"), F.col(key).cast("string"))
    )


def _profiles(df: DataFrame, key: str, entity: str, cls: str) -> tuple[DataFrame, DataFrame]:
    """Records per class of every group, and one row with the classes and their totals."""
    counts = df.groupBy(
        group_id(entity, key).alias("group"), F.coalesce(F.col(cls).cast("string"), F.lit("")).alias("class")
    ).agg(F.count("*").alias("n"))
    counts = stage(counts, "group_counts")
    totals = counts.groupBy("class").agg(F.sum("n").alias("total"))
    listed = F.array_sort(F.collect_list(F.struct("class", "total")))
    totals = totals.agg(listed["class"].alias("classes"), listed["total"].alias("totals"), F.sum("total").alias("all"))
    totals = stage(totals, "group_totals")
    profiles = counts.groupBy("group").agg(
        F.sum("n").alias("size"), F.map_from_entries(F.collect_list(F.struct("class", "n"))).alias("of")
    )
    profiles = with_scalar(profiles, totals, "_T").withColumn(
        "counts", F.transform("_T.classes", lambda c: F.coalesce(F.try_element_at("of", c), F.lit(0)))
    )
    share = F.transform(F.arrays_zip("counts", F.col("_T.totals").alias("totals")), lambda x: x["counts"] / x["totals"])
    return profiles.select(
        "group",
        "size",
        "counts",
        F.array_position(share, F.array_max(share)).cast("int").alias("lead"),
        (F.col("size") * MOST_LARGE >= F.col("_T.all")).alias("large"),
        F.length(F.bin("size")).alias("order_of_size"),
    ), totals


def _place_large(large: DataFrame, totals: DataFrame, shares: tuple[float, ...], repeats: int) -> DataFrame:
    """One row per repeat: what every part lacks of every class afterwards (``lacks``, part by
    part), and the groups' parts (``placed``). At most MOST_LARGE groups are listed."""
    parts = len(shares)
    every = large.sparkSession.range(1, repeats + 1).select(F.col("id").cast("int").alias("repeat"))
    listed = F.array_sort(F.collect_list(F.struct(-F.col("order_of_size"), "_h", "group", "counts")))
    listed = large.groupBy("repeat").agg(listed.alias("queue"))
    rows = with_scalar(every.join(listed, "repeat", "left"), totals, "_T")
    rows = rows.withColumn("_C", F.size("_T.classes"))
    start = F.flatten(F.array(*[F.transform("_T.totals", lambda t: t * F.lit(s)) for s in shares]))
    rows = rows.withColumn("_start", start)
    gains = f"""transform(sequence(0, {parts - 1}), p -> round(aggregate(sequence(0, _C - 1), 0D,
        (s, c) -> s + g.counts[c] * acc.lacks[p * _C + c] / _T.totals[c]), 6))"""
    folded = F.expr(
        f"""aggregate(coalesce(queue, array()), named_struct('lacks', _start,
              'placed', cast(array() as array<struct<group: string, part: int>>)),
            (acc, g) -> transform(array({gains}), w -> transform(array(cast(array_position(w, array_max(w)) - 1 as int)), b ->
              named_struct('lacks', transform(acc.lacks, (v, i) -> if(i div _C = b, v - g.counts[cast(i % _C as int)], v)),
                           'placed', concat(acc.placed, array(named_struct('group', g.group, 'part', b)))))[0])[0])"""
    )
    return rows.withColumn("_done", folded).select("repeat", "_done.lacks", "_done.placed")


def _place_small(small: DataFrame, lacks: DataFrame, shares: tuple[float, ...], digits: int = 3) -> DataFrame:
    stratum = ["repeat", "lead", "order_of_size"]
    small = small.withColumn("_cell", F.substring("_h", 1, digits))
    in_order = Window.partitionBy(*stratum).orderBy("_cell")
    cells = small.groupBy(*stratum, "_cell").agg(F.sum("size").alias("_n"))
    cells = cells.select(
        *stratum,
        "_cell",
        (F.sum("_n").over(in_order) - F.col("_n")).alias("_before"),
        F.sum("_n").over(Window.partitionBy(*stratum)).alias("_all"),
    )
    upto = F.sum("size").over(Window.partitionBy(*stratum, "_cell").orderBy("_h", "group"))
    placed = small.withColumn("_upto", upto).join(cells, [*stratum, "_cell"])
    # Twice the middle of the group's stretch, and the ends of the parts' stretches.
    middle = 2 * (F.col("_before") + F.col("_upto")) - F.col("size")
    classes = F.size("lacks") / F.lit(len(shares))
    lacking = [
        F.greatest(F.element_at("lacks", (F.lit(p) * classes + F.col("lead")).cast("int")), F.lit(0.0)) for p in range(len(shares))
    ]
    # One map of a few rows, attached without a join: rows of a repeat need not meet.
    table = lacks.agg(F.map_from_entries(F.collect_list(F.struct("repeat", "lacks"))).alias("_m"))
    placed = placed.withColumn("lacks", F.element_at(table.scalar(), F.col("repeat")))
    placed = placed.withColumns({f"_l{p}": c for p, c in enumerate(lacking)})
    some = sum((F.col(f"_l{p}") for p in range(len(shares))), F.lit(0.0))
    ends, bounds, part = F.lit(0.0), [], None
    for p, s in enumerate(shares):
        ends = ends + F.when(some > 0, F.col(f"_l{p}")).otherwise(F.lit(s))
        bounds.append(ends)
    for p in reversed(range(len(shares))):
        inside = middle.cast("double") * bounds[-1] < 2.0 * F.col("_all") * bounds[p]
        part = F.lit(p) if p == len(shares) - 1 else F.when(inside, F.lit(p)).otherwise(part)
    return placed.select("repeat", "group", part.cast("int").alias("part"))


def group_parts(
    df: DataFrame, key: str, entity: str, cls: str, shares: tuple[float, ...], repeats: int = 1, seed: object = SEED
) -> DataFrame:
    """``key``, repeat and part (from 0) of every record; an entity's records share a part."""
    profiles, totals = _profiles(df, key, entity, cls)
    profiles = profiles.withColumn("repeat", F.explode(F.sequence(F.lit(1), F.lit(repeats))))
    profiles = stage(profiles.withColumn("_h", keyed_md5(seed, "repeat", "group")), "group_profiles")
    large = stage(_place_large(profiles.where("large"), totals, shares, repeats), "group_large")
    small = _place_small(profiles.where("not large"), large.select("repeat", "lacks"), shares)
    placed = large.select("repeat", F.inline("placed")).unionByName(small)
    of = placed.groupBy("group").agg(F.collect_list(F.struct("repeat", "part")).alias("_in"))
    records = df.select(F.col(key), group_id(entity, key).alias("group"))
    return salted_lookup(records, stage(of, "group_parts"), "group", key).select(key, F.inline("_in"))


def group_split(
    df: DataFrame, key: str, entity: str, cls: str, shares: tuple[float, ...] = SHARES, seed: object = SEED
) -> DataFrame:
    """P5: split index in which no entity is in two parts."""
    names = F.array(*[F.lit(n) for n in NAMES])
    parts = group_parts(df, key, entity, cls, shares, 1, seed)
    return parts.select(key, F.element_at(names, F.col("part") + 1).alias("split"))


def group_folds(df: DataFrame, key: str, entity: str, cls: str, k: int, repeats: int, seed: object = SEED) -> DataFrame:
    """Fold index (key, repeat, fold) in which no entity is in two folds of a repeat."""
    parts = group_parts(df, key, entity, cls, (1.0 / k,) * k, repeats, seed)
    return parts.select(key, "repeat", F.col("part").alias("fold"))
