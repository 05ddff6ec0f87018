"""Global view weights and fusion of view scores (F5-F7), all row-local.

A record's views sit side by side in one row, so fusing them needs no grouping:
the long form would shuffle every (record, view) row by record.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.scalars import total
from plumbline.operators.reliability import best_params, reliability
from plumbline.spec import ViewSpec

MIN_WEIGHT = 1e-6


def fit_view_weights(val: DataFrame, spec: ViewSpec, y: str = "y", by: list[str] = ()) -> DataFrame:
    """``g_<view>``: gap between the mean scores of the two classes on validation rows."""
    aggs = []
    for v in spec.names:
        p = F.col(f"p_{v}")
        apart = F.avg(F.when(F.col(y) == 1, p)) - F.avg(F.when(F.col(y) == 0, p))
        aggs.append(F.greatest(F.abs(apart), F.lit(MIN_WEIGHT)).alias(f"g_{v}"))
    return val.groupBy(*by).agg(*aggs)


def weights_long(weights: DataFrame, spec: ViewSpec, by: list[str] = ()) -> DataFrame:
    rows = F.array(
        *[F.struct(F.lit(v).alias("view"), F.col(f"g_{v}").alias("g")) for v in spec.names]
    )
    return weights.select(*by, F.inline(rows))


def weight_columns(spec: ViewSpec, prefix: str = "") -> dict[str, Column]:
    dot = f"{prefix}." if prefix else ""
    return {v: F.col(f"{dot}g_{v}") for v in spec.names}


def evidence_weights(
    spec: ViewSpec, g: dict[str, Column], alpha: tuple[object, object, object]
) -> dict[str, Column]:
    """``w_<view>``: global weight times record reliability; null without a score."""
    r = reliability(spec, alpha)
    return {
        f"w_{v}": F.when(F.col(f"p_{v}").isNotNull(), g[v] * r[f"r_{v}"]) for v in spec.names
    }


def weight_total(spec: ViewSpec) -> Column:
    return total([F.coalesce(f"w_{v}", F.lit(0.0)) for v in spec.names])


def weighted_scores(spec: ViewSpec) -> Column:
    return total([F.coalesce(F.col(f"w_{v}") * F.col(f"p_{v}"), F.lit(0.0)) for v in spec.names])


def fused(spec: ViewSpec) -> Column:
    """mean of the view scores weighted by ``w_<view>``; null when none has a score.

    The weights are columns of their own: inlining them wherever they are used
    would grow the generated code past what the JVM compiles.
    """
    return F.try_divide(weighted_scores(spec), weight_total(spec))


def unweighted(spec: ViewSpec) -> Column:
    """plain mean of the views that have a score."""
    up = total([F.coalesce(f"p_{v}", F.lit(0.0)) for v in spec.names])
    down = total([F.col(f"p_{v}").isNotNull().cast("int") for v in spec.names])
    return F.try_divide(up, down.cast("double"))


def fuse(df: DataFrame, spec: ViewSpec, g: dict[str, Column], alpha: tuple[object, object, object]) -> DataFrame:
    """Adds ``w_<view>`` and the fused score ``s``."""
    return df.withColumns(evidence_weights(spec, g, alpha)).withColumn("s", fused(spec))


def alpha_columns(prefix: str) -> tuple[Column, Column, Column]:
    return tuple(F.col(f"{prefix}.{n}") for n in ("a_i", "a_q", "a_t"))


def fit_alpha(
    val: DataFrame, spec: ViewSpec, grid: list[dict[str, float]], g_prefix: str = "_G", by: list[str] = ()
) -> DataFrame:
    """Reliability coefficients with the lowest Brier score of the fused validation score.

    The fused score is a ratio of sums over the factors, weighted by the coefficients: a row
    yields the sums once, and every candidate follows from them without a copy of the row.
    """
    g, up, down = weight_columns(spec, g_prefix), {}, {}
    for a, factor in (("a_i", lambda v: "i"), ("a_q", lambda v: f"q_{v}"), ("a_t", lambda v: "t")):
        known = {v: total([F.col(c) for c in ("i", f"q_{v}", "t", f"p_{v}")]).isNotNull() for v in spec.names}
        weight = {v: F.coalesce(F.when(known[v], g[v] * F.col(factor(v))), F.lit(0.0)) for v in spec.names}
        up[a] = total([weight[v] * F.coalesce(f"p_{v}", F.lit(0.0)) for v in spec.names])
        down[a] = total(list(weight.values()))
    rows = val.select(*by, "y", *[x.alias(f"_{n}_{a}") for n, part in (("up", up), ("down", down)) for a, x in part.items()])
    losses = []
    for k, point in enumerate(grid):
        mix = lambda n: total([F.lit(float(point[a])) * F.col(f"_{n}_{a}") for a in up])
        miss = F.try_divide(mix("up"), mix("down")) - F.col("y")
        losses.append(F.avg(miss * miss).alias(f"_loss_{k}"))
    means = rows.groupBy(*by).agg(F.count("*").alias("_rows"), *losses).where("_rows > 0")
    tried = F.array(
        *[
            F.struct(F.lit(k).alias("grid_id"), *[F.lit(float(x)).alias(n) for n, x in point.items()], F.col(f"_loss_{k}").alias("loss"))
            for k, point in enumerate(grid)
        ]
    )
    return best_params(means.select(*by, F.inline(tried)), list(grid[0]), by)
