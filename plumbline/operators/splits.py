"""Partitions, folds and their determinism."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.scalars import hash_bucket
from plumbline.operators.ranking import with_hash_rank

# Upper bucket bounds of train and validation, and the seed.
TRAIN_BELOW, VALIDATION_BELOW = 60, 80
SEED = 42


def _named(bucket: Column, low: object, high: object) -> Column:
    return F.when(bucket < low, "train").when(bucket < high, "validation").otherwise("test")


def split_of(key: str, seed: object = SEED, low: int = TRAIN_BELOW, high: int = VALIDATION_BELOW) -> Column:
    """Split by a hash of the record key: row-local, no shuffle, same for every model."""
    return _named(hash_bucket(seed, key), low, high)


def assign_split(df: DataFrame, key: str, seed: object = SEED) -> DataFrame:
    return df.withColumn("split", split_of(key, seed))


def stratified_split(
    df: DataFrame,
    key: str,
    cls: str,
    seed: object = SEED,
    low: int = TRAIN_BELOW,
    high: int = VALIDATION_BELOW,
    digits: int = 3,
) -> DataFrame:
    """Split index with exact shares inside each class: 0-based rank * 100 / class size."""
    strata = df.select(key, F.coalesce(F.col(cls).cast("string"), F.lit("")).alias("stratum"))
    ranked = with_hash_rank(strata, ["stratum"], key, seed, digits=digits, name="_rank", size="_size")
    position, size = (F.col("_rank") - 1) * 100, F.col("_size")
    return ranked.select(
        key,
        "stratum",
        F.when(position < F.lit(low) * size, "train")
        .when(position < F.lit(high) * size, "validation")
        .otherwise("test")
        .alias("split"),
    )


def assign_folds(
    df: DataFrame,
    key: str,
    cls: str,
    k: int,
    repeats: int,
    seed: object = SEED,
    digits: int = 3,
) -> DataFrame:
    """Fold index (key, repeat, fold): stratified, balanced to one record per class."""
    rows = df.select(
        key,
        F.coalesce(F.col(cls).cast("string"), F.lit("")).alias("stratum"),
        F.explode(F.sequence(F.lit(1), F.lit(repeats))).alias("repeat"),
    )
    ranked = with_hash_rank(
        rows, ["repeat", "stratum"], key, seed, seed_cols=("repeat",), digits=digits, name="_rank"
    )
    return ranked.select(
        key, "stratum", "repeat", F.pmod(F.col("_rank") - 1, F.lit(k)).cast("int").alias("fold")
    )
