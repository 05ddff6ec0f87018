"""Isotonic calibration of a confidence (F9) and its calibration error.

Validation rows are counted in ``CELLS`` equal cells of [0, 1], whatever their number. Adjacent
violators are pooled inside ranges of cells first, then the blocks that are left are pooled
over all ranges; pooling parts before the whole gives the same blocks. Both steps read at most
``CELLS`` + 1 counts. The fit is one row with a value per cell, so applying it needs no join.

Defined cases: a record without a confidence has no calibrated one and fits nothing; cells
between blocks take the value of the block below, cells below the first block its value;
without any validation row the calibrated value is null.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.scalars import col, with_scalar

# Cells of the confidence, cells of a range that is pooled by itself, bins of the error.
CELLS, RANGE, BINS = 4096, 256, 10


def cell_of(value: str | Column, cells: int = CELLS) -> Column:
    """Rounded first, so that sums that differ in their last bit share a cell; null without a value."""
    inside = F.least(F.greatest(F.round(col(value), 9), F.lit(0.0)), F.lit(1.0))
    return F.when(col(value).isNotNull(), F.floor(inside * cells).cast("int"))


def pool(blocks: Iterable[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Blocks (first cell, rows, hits) with shares that rise strictly, in whole numbers."""
    out: list[tuple[int, int, int]] = []
    for cell, n, hits in blocks:
        while out and out[-1][2] * n >= hits * out[-1][1]:
            cell, below_n, below_hits = out.pop()
            n, hits = n + below_n, hits + below_hits
        out.append((cell, n, hits))
    return out


def _pooled(part: pd.DataFrame) -> list[tuple[int, int, int]]:
    part = part.sort_values("cell")
    return pool(zip(*(map(int, part[c]) for c in ("cell", "n", "hits"))))


def fit_isotonic(val: DataFrame, value: str, hit: str, cells: int = CELLS, width: int = RANGE) -> DataFrame:
    """One row: ``values``, the calibrated value of every cell. ``hit`` is 0 or 1."""
    known = val.where(F.col(value).isNotNull() & F.col(hit).isNotNull())
    counts = known.groupBy(cell_of(value, cells).alias("cell")).agg(
        F.count("*").alias("n"), F.sum(F.col(hit).cast("long")).alias("hits")
    )

    def pool_range(part: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(_pooled(part), columns=["cell", "n", "hits"])

    blocks = counts.groupBy(F.floor(F.col("cell") / width).alias("range")).applyInPandas(
        pool_range, "cell int, n long, hits long"
    )
    listed = blocks.agg(F.sort_array(F.collect_list(F.struct("cell", "n", "hits"))).alias("blocks"))

    def per_cell(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for listed_blocks in part["blocks"]:
                final = pool((b["cell"], b["n"], b["hits"]) for b in listed_blocks)
                values, at = [], 0
                for cell in range(cells + 1 if final else 0):
                    while at + 1 < len(final) and final[at + 1][0] <= cell:
                        at += 1
                    values.append(final[at][2] / final[at][1])
                rows.append(values)
            yield pd.DataFrame({"values": rows})

    return listed.mapInPandas(per_cell, "values array<double>")


def calibrate(df: DataFrame, value: str, fitted: DataFrame, name: str = "calibrated", cells: int = CELLS) -> DataFrame:
    df = with_scalar(df, fitted, "_V")
    return df.withColumn(name, F.get("_V.values", cell_of(value, cells))).drop("_V")


def calibration_error(df: DataFrame, values: list[str], hit: str, by: list[str] = (), bins: int = BINS) -> DataFrame:
    """Expected and largest gap between confidence and share of hits over ``bins`` equal bins, and the
    Brier score, per group and measure. Every task shrinks its rows to groups x measures x bins."""
    rows = F.array(*[F.struct(F.lit(v).alias("measure"), F.col(v).alias("c")) for v in values])
    long = df.where(F.col(hit).isNotNull()).select(*by, F.col(hit).cast("double").alias("h"), F.inline(rows))
    long = long.where(F.col("c").isNotNull())
    bin_ = F.least(cell_of("c", bins), F.lit(bins - 1)).alias("bin")
    binned = long.groupBy(*by, "measure", bin_).agg(
        F.count("*").alias("n"),
        F.abs(F.avg("c") - F.avg("h")).alias("gap"),
        F.sum((F.col("c") - F.col("h")) * (F.col("c") - F.col("h"))).alias("sse"),
    )
    n = F.sum("n")
    return binned.groupBy(*by, "measure").agg(
        n.alias("n"),
        F.count("*").alias("bins"),
        (F.sum(F.col("n") * F.col("gap")) / n).alias("expected_error"),
        F.max("gap").alias("largest_error"),
        (F.sum("sse") / n).alias("brier"),
    )
