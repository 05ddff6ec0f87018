"""Artifacts written for audit: splits, predictions, models, run logs."""

from __future__ import annotations

import uuid

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _partitioned(df: DataFrame, path: str, columns: list[str], mode: str) -> None:
    """One directory per value, in files of the advisory partition size.

    The rebalance hint gathers each value's rows instead of leaving a small file
    per task and value; adaptive execution splits a dominant value over tasks.
    """
    df.hint("rebalance", *columns).write.mode(mode).partitionBy(*columns).parquet(path)


def write_splits(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Split index, one directory per split."""
    _partitioned(df, path, ["split"], mode)


def write_predictions(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Per-view predictions, one directory per dataset and view."""
    _partitioned(df, path, ["dataset", "view"], mode)


def write_bucketed(df: DataFrame, path: str, key: str, buckets: int, name: str | None = None) -> DataFrame:
    """A table at ``path`` bucketed and sorted by ``key``, read back.

    Tables with as many buckets of the same key are joined and grouped by it without a
    shuffle. ``key`` is nearly unique, like a record's id; one file is written per bucket.
    The catalog of the session knows the table as ``name``.
    """
    name = name or f"bucketed_{uuid.uuid4().hex[:12]}"
    writer = df.repartition(buckets, key).write.mode("errorifexists").option("path", path)
    writer.bucketBy(buckets, key).sortBy(key).saveAsTable(name)
    return df.sparkSession.table(name)


def save_params(params: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """A fitted parameter table; it has one row per view, feature and class."""
    params.coalesce(1).write.mode(mode).parquet(path)


def load_params(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def append_run_log(df: DataFrame, path: str) -> None:
    """Execution log rows appended as a table."""
    df.select(
        F.col("run_id").cast("string"),
        F.col("stage").cast("string"),
        F.col("rows").cast("long"),
        F.col("seconds").cast("double"),
        F.col("started").cast("timestamp"),
    ).write.mode("append").parquet(path)
