"""Integrity of source files and the records derived from them.

Integrity belongs to the acquired file and is passed on to its records; it says
nothing about the authenticity of a single record.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.scalars import col
from plumbline.operators.joins import salted_lookup


def verify_integrity(recorded: DataFrame, recomputed: DataFrame, file: str = "file", digest: str = "sha256") -> DataFrame:
    """Recorded against recomputed digest per file.

    ``missing``: recorded but no longer found; ``unlisted``: found but never
    recorded. Both sides have one row per file, so no key is hot.
    """
    a = recorded.select(file, F.col(digest).alias("recorded"))
    b = recomputed.select(file, F.col(digest).alias("recomputed"))
    status = (
        F.when(F.col("recomputed").isNull(), "missing")
        .when(F.col("recorded").isNull(), "unlisted")
        .when(F.col("recorded") == F.col("recomputed"), "verified")
        .otherwise("mismatch")
    )
    return a.join(b, file, "full_outer").withColumn("status", status)


def altered_blocks(recorded: DataFrame, recomputed: DataFrame) -> DataFrame:
    """file and part of every block whose digest differs, or that only one side has."""
    a, b = (x.select("file", "part", F.col("sha256").alias(n)) for x, n in ((recorded, "recorded"), (recomputed, "recomputed")))
    both = a.join(b, ["file", "part"], "full_outer")
    return both.where(~F.col("recorded").eqNullSafe(F.col("recomputed")))


def attach_integrity(flows: DataFrame, manifest: DataFrame, record_id: str = "record_id", file: str = "file") -> DataFrame:
    """The file's integrity context on every derived record."""
    return salted_lookup(flows, manifest, file, spread_by=record_id)


def integrity_factor(status: str | Column = "status") -> Column:
    """F1: 1 for verified, 0 for mismatch, 0.5 when nothing is known."""
    s = col(status)
    return (
        F.when(s == "verified", F.lit(1.0)).when(s == "mismatch", F.lit(0.0)).otherwise(F.lit(0.5))
    )
