"""Row-local column expressions; everything here stays inside JVM codegen."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def finite(c: str | Column) -> Column:
    """The value as double, or null when it is null, NaN or infinite."""
    x = col(c).cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), x)


def keyed_md5(seed: object, *keys: str | Column) -> Column:
    """Hex digest of ``seed|key|...``: the only source of randomness here."""
    parts = [F.lit(str(seed)), *[col(k).cast("string") for k in keys]]
    return F.md5(F.concat_ws("|", *parts))


def hash_bucket(seed: object, *keys: str | Column, buckets: int = 100) -> Column:
    """Deterministic bucket in ``[0, buckets)`` from the first 32 digest bits."""
    head = F.substring(keyed_md5(seed, *keys), 1, 8)
    return F.conv(head, 16, 10).cast("long") % F.lit(buckets)


def micros(c: str | Column) -> Column:
    """Microseconds since the epoch; the session time zone must be UTC."""
    return F.unix_micros(col(c).cast("timestamp"))


def total(cols: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, cols)


def logistic(z: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def with_scalar(df: DataFrame, one_row: DataFrame, name: str) -> DataFrame:
    """Attach a one-row table as a struct column.

    Planned as a scalar subquery: evaluated once, shipped as a constant, no
    join and no shuffle of ``df``. Spark fails the query if it is not one row.
    """
    return df.withColumn(name, one_row.select(F.struct("*")).scalar())


def long_features(df: DataFrame, features: list[str], keep: list[str]) -> DataFrame:
    """``keep`` plus one row (``_f``, ``_x``) per feature, ``_f`` being its position.

    Statistics over many features are cheapest in this shape: three aggregates
    grouped by (feature, class) stay in compiled code, where hundreds of
    conditional aggregates side by side do not. The groups are few, so every
    task shrinks its rows to them before the shuffle.
    """
    cells = [F.struct(F.lit(j).alias("_f"), F.col(f).alias("_x")) for j, f in enumerate(features)]
    return df.select(*keep, F.inline(F.array(*cells)))


def with_fitted(df: DataFrame, fitted: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    """Attach a fitted table of few rows by its keys, without a shuffle of ``df``.

    ``fitted`` has one row per declared variant, dataset or (repeat, fold). It is sent to
    every task as a hash table: rows of one key never have to meet, whatever the planner
    thinks of sizes, and a row finds its values at once, however many models there are. A
    group that was not fitted keeps its rows, with nulls; a null key is a key.
    """
    if not keys:
        row = fitted.select(F.struct(*names)).scalar()
        return df.withColumn("_m", row).withColumns({n: F.col(f"_m.{n}") for n in names}).drop("_m")
    side = fitted.select(
        *[F.col(k).alias(f"_key_{k}") for k in keys], *[F.col(n).alias(f"_value_{n}") for n in names]
    )
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_key_{k}")) for k in keys])
    joined = df.join(F.broadcast(side), same, "left")
    return joined.withColumns({n: F.col(f"_value_{n}") for n in names}).drop(*side.columns)
