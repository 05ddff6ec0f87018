"""Semantic evidence views: long form for storage, wide form for scoring."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.scalars import finite, total
from plumbline.spec import ViewSpec


def finite_features(df: DataFrame, spec: ViewSpec) -> DataFrame:
    return df.withColumns({f: finite(f) for f in spec.features})


def to_views(df: DataFrame, spec: ViewSpec, keep: list[str]) -> DataFrame:
    """One row per (record, view, feature): a single scan and no shuffle."""
    cells = F.array(
        *[
            F.struct(F.lit(v).alias("view"), F.lit(f).alias("feature"), finite(f).alias("x"))
            for v, f in spec.pairs
        ]
    )
    return df.select(*keep, F.inline(cells))


def melt_views(df: DataFrame, spec: ViewSpec, keep: list[str], **prefixes: str) -> DataFrame:
    """Per-view columns ``<prefix><view>`` to rows: ``melt_views(df, s, k, p="p_")``."""
    rows = F.array(
        *[
            F.struct(
                F.lit(v).alias("view"),
                *[F.col(prefix + v).alias(name) for name, prefix in prefixes.items()],
            )
            for v in spec.names
        ]
    )
    return df.select(*keep, F.inline(rows))


def quality(spec: ViewSpec, view: str) -> Column:
    """share of the view's features that are present and finite."""
    feats = spec.views[view]
    valid = total([F.when(finite(f).isNotNull(), 1).otherwise(0) for f in feats])
    return valid / F.lit(float(len(feats)))


def with_quality(df: DataFrame, spec: ViewSpec) -> DataFrame:
    return df.withColumns({f"q_{v}": quality(spec, v) for v in spec.names})
