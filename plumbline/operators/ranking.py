"""Exact ranks and quantiles without one task per group.

A class or a dataset may hold most of the rows, so ``row_number`` partitioned by
it alone would sort them in a single task. Here the order is cut into cells, the
cells are counted by a partial aggregate, and only rows of one cell meet.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.scalars import keyed_md5
from plumbline.session import stage


def with_hash_rank(
    df: DataFrame,
    by: list[str],
    key: str,
    seed: object,
    seed_cols: tuple[str, ...] = (),
    digits: int = 3,
    name: str = "rank",
    size: str = "group_size",
) -> DataFrame:
    """1-based rank of ``md5(seed|seed_cols|key)`` inside each ``by`` group, and its size.

    Equals ``row_number() over (partition by <by> order by <md5>, key)``. A cell
    is a hex prefix of the digest and holds about ``1 / 16**digits`` of a group;
    the running count over cells reads at most ``16**digits`` rows per group.
    """
    digest = keyed_md5(seed, *seed_cols, key)
    # Bytes sort as their hex digits do, in half the room.
    hashed = df.withColumns({"_h": F.unhex(digest), "_cell": F.conv(F.substring(digest, 1, digits), 16, 10).cast("long")})
    in_order = Window.partitionBy(*by).orderBy("_cell")
    whole = Window.partitionBy(*by)
    before = (
        hashed.groupBy(*by, "_cell")
        .agg(F.count("*").alias("_n"))
        .select(
            *by,
            "_cell",
            (F.sum("_n").over(in_order) - F.col("_n")).alias("_before"),
            F.sum("_n").over(whole).alias(size),
        )
    )
    in_cell = Window.partitionBy("_cell", *by).orderBy("_h", key)
    return (
        hashed.withColumn("_rn", F.row_number().over(in_cell))
        .join(before, [*by, "_cell"])
        .withColumn(name, F.col("_before") + F.col("_rn"))
        .drop("_h", "_cell", "_rn", "_before")
    )


# Cells of a first and a second look: about 2**12 and 2**32 to a doubling of the value. A
# cell of the second look holds at most 2**21 distinct doubles.
LOOKS = (12, 32)


def value_cell(x: Column, bits: int) -> Column:
    """A number that never falls as ``x`` rises: power of two and the first ``bits`` bits after it."""
    size = F.abs(x)
    power = F.greatest(F.floor(F.log2(F.when(size > 0, size))), F.lit(-1022))
    part = F.floor((size / F.pow(F.lit(2.0), power) - 1) * F.lit(float(2**bits)))
    steps = F.least(F.greatest(part, F.lit(0)), F.lit(2**bits - 1))
    cell = (power + F.lit(1100)) * F.lit(2**bits) + steps
    return F.when(x > 0, cell).when(x < 0, -cell).otherwise(F.lit(0)).cast("long")


def exact_quantiles(df: DataFrame, by: list[str], value: str, probs: dict[str, float]) -> DataFrame:
    """Interpolated quantiles per group, exact, from counts.

    The first pass counts values per cell; running sums give the cells of the ranks
    asked for. The second pass counts finer cells inside those, the third the values
    inside the finer ones. Every pass shrinks its rows to counts before the shuffle, and
    no window reads more than the cells of one group, so a group may hold any share of
    the rows. Values must be finite; a null group is a group.
    """
    plist = list(probs.values())
    key = F.struct(*[F.col(c).alias(f"k{j}") for j, c in enumerate(by)])
    x = df.where(F.col(value).isNotNull()).select(key.alias("_g"), F.col(value).cast("double").alias("_x"))
    position = lambda p: F.lit(float(p)) * (F.col("_n") - 1)
    ranks = F.array(
        *[
            F.struct(F.lit(2 * j + side).alias("slot"), edge(position(p)).cast("long").alias("rank"))
            for j, p in enumerate(plist)
            for side, edge in enumerate((F.floor, F.ceil))
        ]
    )

    def at_rank(cells: DataFrame, over: list[str], slots: Column | None) -> DataFrame:
        """The cell of each slot's rank, and how many values of the group's part come before it."""
        upward = Window.partitionBy(*over).orderBy("_cell")
        summed = cells.withColumn("_end", F.sum("_c").over(upward))
        if slots is not None:
            summed = summed.withColumn("_n", F.sum("_c").over(Window.partitionBy(*over)))
            summed = summed.select("*", F.inline(slots))
        inside = (F.col("rank") < F.col("_end")) & (F.col("rank") >= F.col("_end") - F.col("_c"))
        return summed.where(inside).withColumn("rank", F.col("rank") - F.col("_end") + F.col("_c"))

    first = x.groupBy("_g", value_cell(F.col("_x"), LOOKS[0]).alias("_cell")).agg(F.count("*").alias("_c"))
    found = at_rank(first, ["_g"], ranks).select("_g", "_n", "slot", "rank", F.col("_cell").alias("_in"))
    for bits, outer in ((LOOKS[1], LOOKS[0]), (None, LOOKS[1])):
        # A few rows per group, as one map: rows of a hot group do not have to meet it.
        wanted = stage(found, "quantile_cells")
        spots = wanted.groupBy("_g").agg(F.collect_set("_in").alias("cells"))
        table = spots.agg(F.map_from_entries(F.collect_list(F.struct("_g", "cells"))).alias("_m"))
        near = x.withColumn("_in", value_cell(F.col("_x"), outer)).withColumn("_m", table.scalar())
        near = near.where(F.array_contains(F.try_element_at("_m", F.col("_g")), F.col("_in")))
        cell = value_cell(F.col("_x"), bits) if bits else F.col("_x")
        counts = near.groupBy("_g", "_in", cell.alias("_cell")).agg(F.count("*").alias("_c"))
        slots = wanted.select("_g", "_in", F.col("_n"), "slot", "rank")
        upward = Window.partitionBy("_g", "_in").orderBy("_cell")
        ends = counts.withColumn("_end", F.sum("_c").over(upward))
        joined = ends.alias("e").join(
            slots.alias("s"), F.col("e._g").eqNullSafe(F.col("s._g")) & (F.col("e._in") == F.col("s._in"))
        )
        hit = (F.col("rank") < F.col("_end")) & (F.col("rank") >= F.col("_end") - F.col("_c"))
        found = joined.where(hit).select(
            F.col("e._g").alias("_g"), "_n", "slot", (F.col("rank") - F.col("_end") + F.col("_c")).alias("rank"),
            F.col("_cell").alias("_in"),
        )
    out = []
    for j, (name, p) in enumerate(probs.items()):
        low, high = (F.max(F.when(F.col("slot") == 2 * j + side, F.col("_in"))) for side in (0, 1))
        share = F.max(position(p)) - F.floor(F.max(position(p)))
        out.append((low + share * (high - low)).alias(name))
    per_group = found.groupBy("_g").agg(*out)
    return per_group.select(*[F.col(f"_g.k{j}").alias(c) for j, c in enumerate(by)], *probs)


def same_group(left: str, right: str, by: list[str]) -> Column:
    """Join condition on the columns ``by`` of two aliases; null matches null."""
    parts = [F.col(f"{left}.{c}").eqNullSafe(F.col(f"{right}.{c}")) for c in by]
    return reduce(lambda a, b: a & b, parts)
