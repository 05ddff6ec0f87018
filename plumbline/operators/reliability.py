"""Reliability of a view's evidence for one record, and its coefficients."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.spec import ViewSpec

# Starting coefficients for integrity, quality, time.
ALPHA = (0.4, 0.3, 0.3)


def reliability(spec: ViewSpec, alpha: tuple[object, object, object] = ALPHA) -> dict[str, Column]:
    """``r_<view>`` columns from ``i``, ``q_<view>`` and ``t``; row-local."""
    a_i, a_q, a_t = (a if isinstance(a, Column) else F.lit(float(a)) for a in alpha)
    return {
        f"r_{v}": a_i * F.col("i") + a_q * F.col(f"q_{v}") + a_t * F.col("t") for v in spec.names
    }


def simplex_grid(names: tuple[str, ...], steps: int = 5) -> list[dict[str, float]]:
    """All non-negative coefficient vectors with step ``1/steps`` that sum to one."""

    def fill(left: int, slots: int) -> list[list[int]]:
        if slots == 1:
            return [[left]]
        return [[k, *rest] for k in range(left + 1) for rest in fill(left - k, slots - 1)]

    return [
        {n: k / steps for n, k in zip(names, point)} for point in fill(steps, len(names))
    ]


def select_params(
    val: DataFrame,
    grid: list[dict[str, float]],
    with_loss: Callable[[DataFrame], DataFrame],
    by: list[str] = (),
) -> DataFrame:
    """The grid point with the lowest mean loss on validation rows, one row per group.

    ``with_loss`` adds ``_loss`` to rows that carry a candidate's fields as
    ``_cand.<name>``.
    The grid is a literal exploded inside the scan stage, so one pass evaluates
    every candidate and the shuffle carries one row per task and candidate. Ties
    on the loss, rounded to nine digits, go to the earlier grid point.
    """
    candidates = F.array(
        *[
            F.struct(
                F.lit(k).alias("grid_id"), *[F.lit(float(x)).alias(n) for n, x in point.items()]
            )
            for k, point in enumerate(grid)
        ]
    )
    means = (
        with_loss(val.withColumn("_cand", F.explode(candidates)))
        .groupBy(*by, "_cand")
        .agg(F.avg("_loss").alias("loss"))
    )
    return best_params(means.select(*by, "_cand.*", "loss"), list(grid[0]), by)


def best_params(tried: DataFrame, names: list[str], by: list[str] = ()) -> DataFrame:
    """The candidate (``grid_id`` and ``names``) with the lowest ``loss`` of each group."""
    order = F.struct(F.round("loss", 9).alias("loss"), F.col("grid_id").alias("grid_id"))
    best = tried.groupBy(*by).agg(F.min_by(F.struct("grid_id", *names, "loss"), order).alias("_b"))
    return best.select(*by, "_b.*")
