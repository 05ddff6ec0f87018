"""Cleaning, harmonising and transforming records."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.scalars import finite, long_features, micros, with_scalar
from plumbline.spec import FlowMapping


def clean(
    df: DataFrame,
    key: str,
    casts: Mapping[str, str],
    content: list[str],
    required: list[str] = (),
) -> DataFrame:
    """Typed casts, non-finite to null, unusable rows and exact copies dropped.

    A cell that does not parse becomes null. A row is unusable without key, with
    a required column missing, or with no numeric value at all. Of rows with the
    same ``content`` the one with the lowest key stays, also if the key repeats.
    Copies are grouped by a digest and a hot group shrinks on the map side.
    """
    numeric = [c for c, t in casts.items() if t in ("float", "double")]
    typed = {c: F.col(c).try_cast(t) for c, t in casts.items()}
    df = df.withColumns({**typed, **{c: finite(typed[c]) for c in numeric}})
    df = df.na.drop(subset=[key, *required])
    if numeric:
        df = df.na.drop(how="all", subset=numeric)
    digest = F.sha2(F.to_json(F.struct(*content), {"ignoreNullFields": "false"}), 256)
    row = F.struct(*df.columns)
    kept = F.min_by(row, F.struct(key, F.xxhash64(*df.columns)))
    return df.groupBy(digest.alias("_content")).agg(kept.alias("_row")).select("_row.*")


def duplicate_keys(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.count("*").alias("copies")).where(F.col("copies") > 1)


def require_unique(df: DataFrame, key: str) -> DataFrame:
    """``df`` itself, after checking that ``key`` identifies a record.

    Joins on the record key rely on it. Call it on a staged table: it is a job of
    its own, over the key column only. Hashes of the keys are counted first; only
    keys whose hash occurs twice are compared themselves.
    """
    digest = F.xxhash64(key)
    twice = duplicate_keys(df.select(digest.alias("_h")), "_h")
    if twice.first() is None:
        return df
    worst = duplicate_keys(df.select(key).join(twice, digest == F.col("_h"), "left_semi"), key).first()
    if worst is not None:
        raise ValueError(f"{key} {worst[key]!r} occurs {worst['copies']} times")
    return df


def harmonize(
    datasets: Mapping[str, tuple[DataFrame, FlowMapping]],
    class_map: Mapping[str, Mapping[str, str]],
    benign: str = "benign",
) -> DataFrame:
    """Several datasets to one schema and one class vocabulary.

    The vocabulary is a declared mapping, so it is a literal map rather than a
    join. Features a dataset lacks are null. An unmapped class becomes null and
    so does its label.
    """
    parts = []
    for name, (df, m) in datasets.items():
        names = class_map[name]
        pairs = [F.lit(x) for pair in names.items() for x in pair]
        cls = F.try_element_at(F.create_map(*pairs), m.cls.cast("string"))
        parts.append(
            df.select(
                m.record_id.cast("string").alias("record_id"),
                F.lit(name).alias("dataset"),
                (m.file if m.file is not None else F.lit(None)).cast("string").alias("file"),
                (m.entity if m.entity is not None else F.lit(None)).cast("string").alias("entity"),
                (micros(m.ts) if m.ts is not None else F.lit(None)).cast("long").alias("ts_us"),
                cls.alias("class"),
                F.when(cls.isNotNull(), (cls != F.lit(benign)).cast("int")).alias("y"),
                *[finite(c).alias(f) for f, c in m.features.items()],
                *[c.alias(n) for n, c in m.extra.items()],
            )
        )
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out


def fit_scaler(train: DataFrame, features: list[str], by: list[str] = ()) -> DataFrame:
    """Mean, spread and range per feature; pass training rows only. One row per group."""
    stats = {"mean": F.avg("_x"), "sd": F.stddev_samp("_x"), "min": F.min("_x"), "max": F.max("_x")}
    per_feature = (
        long_features(train, features, list(by))
        .groupBy(*by, "_f")
        .agg(*[a.alias(n) for n, a in stats.items()])
    )
    pick = lambda j, n: F.max(F.when(F.col("_f") == j, F.col(n)))
    return per_feature.groupBy(*by).agg(
        *[pick(j, n).alias(f"{f}__{n}") for j, f in enumerate(features) for n in stats]
    )


def transformed(f: str, how: str, params: str = "_S") -> Column:
    """One feature transformed; a zero spread or range gives null."""
    x = F.col(f)
    stat = lambda k: F.col(f"{params}.{f}__{k}")
    if how == "zscore":
        return F.try_divide(x - stat("mean"), stat("sd"))
    if how == "minmax":
        return F.try_divide(x - stat("min"), stat("max") - stat("min"))
    if how == "clip":
        return F.least(F.greatest(x, stat("min")), stat("max"))
    if how == "log1p":
        return F.signum(x) * F.log1p(F.abs(x))
    raise ValueError(f"unknown transform {how!r}")


def apply_scaler(df: DataFrame, params: DataFrame, features: list[str]) -> DataFrame:
    return transform_features(df, {f: "zscore" for f in features}, params)


def transform_features(
    df: DataFrame, how: Mapping[str, str], params: DataFrame | None = None
) -> DataFrame:
    """Row-local transforms; fitted ones read the one-row ``params`` table."""
    if params is not None:
        df = with_scalar(df, params, "_S")
    df = df.withColumns({f: transformed(f, kind) for f, kind in how.items()})
    return df.drop("_S")

