"""Join of a large table with a keyed side table when one key may be hot."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def salted_lookup(
    fact: DataFrame, side: DataFrame, on: str, spread_by: str, salts: int = 16
) -> DataFrame:
    """Left join on ``on``; ``side`` has one row per key.

    No broadcast hint: the planner broadcasts ``side`` if its size on disk is
    under the session's threshold. Otherwise the shuffle key is (key, salt), so
    the rows of a hot key spread over ``salts`` tasks; ``side`` is repeated once
    per salt. The salt is a hash of the record key, hence stable on retry.
    """
    salt = F.pmod(F.xxhash64(spread_by), F.lit(salts)).cast("int")
    repeated = side.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return fact.withColumn("_salt", salt).join(repeated, [on, "_salt"], "left").drop("_salt")
