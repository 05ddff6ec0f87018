"""Verdict, contributions and confidence of a fused record (F8, F9); row-local."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.scalars import total
from plumbline.operators.fusion import weight_total, weighted_scores
from plumbline.operators.reliability import select_params
from plumbline.spec import ViewSpec

# Starting coefficients for reliability, agreement, margin, and
# the share of the evidence weight both sides need for a contested verdict.
BETA = (0.4, 0.3, 0.3)
CONTESTED_SHARE = 0.3


def reason(
    df: DataFrame,
    spec: ViewSpec,
    theta: Column,
    score: str = "s",
    contested_share: float = CONTESTED_SHARE,
) -> DataFrame:
    """Adds ``contributions``, ``supporting``, ``contradicting`` and ``verdict``.

    Reads ``p_<view>``, ``w_<view>``, ``i`` and the fused score. Intermediate
    values are columns, so that each is computed once per row.
    """
    df = df.withColumns(
        {
            "_all": weight_total(spec),
            "_mass": weighted_scores(spec),
            **{f"_up_{v}": F.col(f"p_{v}") >= theta for v in spec.names},
        }
    )
    side = lambda flag: total(
        [F.when(F.col(f"_up_{v}") == flag, F.col(f"w_{v}")).otherwise(F.lit(0.0)) for v in spec.names]
    )
    shares = {
        f"share_{v}": F.try_divide(F.col(f"w_{v}") * F.col(f"p_{v}"), F.col("_mass"))
        for v in spec.names
    }
    df = df.withColumns({"_for": side(True), "_against": side(False), **shares})
    contribution = lambda v: F.when(
        F.col(f"share_{v}").isNotNull(),
        F.struct(F.col(f"share_{v}").alias("share"), F.lit(v).alias("view")),
    )
    contributions = F.sort_array(
        F.array_compact(F.array(*[contribution(v) for v in spec.names])), asc=False
    )
    least = F.lit(contested_share) * F.col("_all")
    verdict = (
        F.when(F.col(score).isNull() | (F.col("i") == 0), F.lit("insufficient"))
        .when((F.col("_for") >= least) & (F.col("_against") >= least), F.lit("contested"))
        .when(F.col(score) >= theta, F.lit("attack"))
        .otherwise(F.lit("benign"))
    )
    names = lambda flag: F.array_compact(
        F.array(*[F.when(F.col(f"_up_{v}") == flag, F.lit(v)) for v in spec.names])
    )
    return df.withColumns(
        {
            "contributions": contributions,
            "supporting": names(True),
            "contradicting": names(False),
            "verdict": verdict,
        }
    ).drop("_all", "_for", "_against", "_mass", *[f"_up_{v}" for v in spec.names])


def confidence_parts(
    df: DataFrame, spec: ViewSpec, g: dict[str, Column], theta: Column, score: str = "s"
) -> DataFrame:
    """Adds reliability ``c_r``, agreement ``c_a`` and margin ``c_m``, each in [0, 1]."""
    df = df.withColumns(
        {
            "_all": weight_total(spec),
            "_g_all": total(
                [F.when(F.col(f"p_{v}").isNotNull(), g[v]).otherwise(F.lit(0.0)) for v in spec.names]
            ),
            **{f"_off_{v}": F.col(f"p_{v}") - F.col(score) for v in spec.names},
        }
    )
    squares = [
        F.coalesce(F.col(f"w_{v}") * F.col(f"_off_{v}") * F.col(f"_off_{v}"), F.lit(0.0))
        for v in spec.names
    ]
    return df.withColumns(
        {
            "c_r": F.try_divide(F.col("_all"), F.col("_g_all")),
            "c_a": F.lit(1.0) - F.lit(2.0) * F.sqrt(F.try_divide(total(squares), F.col("_all"))),
            "c_m": F.abs(F.col(score) - theta) / F.greatest(theta, F.lit(1.0) - theta),
        }
    ).drop("_all", "_g_all", *[f"_off_{v}" for v in spec.names])


def confidence(beta: tuple[object, object, object] = BETA) -> Column:
    b_r, b_a, b_m = (b if isinstance(b, Column) else F.lit(float(b)) for b in beta)
    return b_r * F.col("c_r") + b_a * F.col("c_a") + b_m * F.col("c_m")


def verdict_correct(y: str = "y") -> Column:
    right = ((F.col("verdict") == "attack") & (F.col(y) == 1)) | (
        (F.col("verdict") == "benign") & (F.col(y) == 0)
    )
    return F.when(right, F.lit(1.0)).otherwise(F.lit(0.0))


def fit_beta(val: DataFrame, grid: list[dict[str, float]]) -> DataFrame:
    """Confidence coefficients with the lowest Brier score of "the verdict is correct"."""

    def with_loss(df: DataFrame) -> DataFrame:
        beta = tuple(F.col(f"_cand.{n}") for n in ("b_r", "b_a", "b_m"))
        return df.withColumn("_miss", confidence(beta) - verdict_correct()).withColumn(
            "_loss", F.col("_miss") * F.col("_miss")
        )

    return select_params(val, grid, with_loss)
