"""Time since an entity's previous record, and the temporal factor."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.scalars import col


def with_gap(
    df: DataFrame,
    record_id: str = "record_id",
    entity: str = "entity",
    ts_us: str = "ts_us",
    cell_seconds: int = 60,
    name: str = "gap",
) -> DataFrame:
    """Seconds since the entity's previous record in (time, id) order.

    Equals ``ts - lag(ts) over (partition by entity order by ts, id)``, without
    sorting one entity in one task. Records sharing an instant are collapsed by
    a partial aggregate; all but the lowest id have gap 0. Distinct instants are
    ordered inside (entity, cell), and the last instant of each cell is carried
    to the next one. The result is joined back on the unique record id, so no
    shuffle key can be hot. Null for the first record and for missing times.
    """
    instants = (
        df.where(F.col(ts_us).isNotNull() & F.col(entity).isNotNull())
        .groupBy(F.col(entity).alias("_e"), F.col(ts_us).alias("_t"))
        .agg(F.min(record_id).alias("_id"))
        .withColumn("_cell", F.floor(F.col("_t") / F.lit(cell_seconds * 1_000_000)))
    )
    inner = instants.withColumn(
        "_prev", F.lag("_t").over(Window.partitionBy("_e", "_cell").orderBy("_t"))
    )
    carried = (
        instants.groupBy("_e", "_cell")
        .agg(F.max("_t").alias("_last"))
        .select(
            "_e",
            "_cell",
            F.lag("_last").over(Window.partitionBy("_e").orderBy("_cell")).alias("_carry"),
        )
    )
    leads = inner.join(carried, ["_e", "_cell"]).select(
        F.col("_id").alias(record_id),
        F.lit(True).alias("_lead"),
        F.coalesce("_prev", "_carry").alias("_before"),
    )
    timed = F.col(ts_us).isNotNull() & F.col(entity).isNotNull()
    gap = F.when(
        timed,
        F.when(F.col("_lead").isNull(), F.lit(0.0)).otherwise(
            (F.col(ts_us) - F.col("_before")) / F.lit(1e6)
        ),
    )
    return df.join(leads, record_id, "left").withColumn(name, gap).drop("_lead", "_before")


def temporal_factor(
    ts_us: str | Column = "ts_us",
    gap: str | Column = "gap",
    in_order: Column | None = None,
    tau: float = 86_400.0,
) -> Column:
    """0 for a missing time or a broken order rule, 0.5 for a first record,
    otherwise ``1 / (1 + gap / tau)``."""
    bad = col(ts_us).isNull()
    if in_order is not None:
        bad = bad | ~F.coalesce(in_order, F.lit(False))
    g = col(gap)
    return (
        F.when(bad, F.lit(0.0))
        .when(g.isNull(), F.lit(0.5))
        .otherwise(F.lit(1.0) / (F.lit(1.0) + g / F.lit(tau)))
    )
