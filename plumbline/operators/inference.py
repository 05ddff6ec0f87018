"""Comparison of many models and resampled intervals.

Score tables have models x metrics x repeats x folds rows. The bootstrap reads records once:
they shrink to sums per block of entities, and blocks are drawn, so that records of one
entity stay together and the draws do not touch records again.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.scalars import hash_bucket, keyed_md5

# Terms of the series of the incomplete gamma function; enough for a statistic below 600.
TERMS = 1000
# Blocks and draws of the bootstrap, share of draws left out on each side.
BLOCKS, DRAWS, TAIL = 512, 400, 0.025
# Shares of a Poisson count of mean 1 being at most 0, 1, 2, ...: beyond the last a double is 1.
POISSON = [math.exp(-1) * sum(1 / math.factorial(i) for i in range(k + 1)) for k in range(15)]


def chi_square_p(x: Column, df: Column) -> Column:
    """Share of a chi-square distribution with whole degrees of freedom above ``x``.

    One minus the incomplete gamma function by its power series; gamma(df / 2 + 1) is the
    product of df/2, df/2 - 1, ... down to 1 or to 1/2 (times the root of pi).
    """
    half, at = df / 2, x / 2
    factors = F.sequence(F.lit(0), F.floor((df - 1) / 2).cast("int"))
    gamma = F.aggregate(factors, F.lit(1.0), lambda acc, k: acc * (half - k))
    gamma = gamma * F.when(df % 2 == 1, F.lit(math.sqrt(math.pi))).otherwise(F.lit(1.0))

    def add(acc: Column, k: Column) -> Column:
        term = acc["term"] * at / (half + k)
        return F.struct(term.alias("term"), (acc["sum"] + term).alias("sum"))

    start = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum"))
    series = F.aggregate(F.sequence(F.lit(1), F.lit(TERMS)), start, add, lambda acc: acc["sum"])
    below = F.pow(at, half) * F.exp(-at) / gamma * series
    p = F.when(x <= 0, F.lit(1.0)).when(x >= 600, F.lit(0.0)).otherwise(F.greatest(F.lit(1.0) - below, F.lit(0.0)))
    return F.when((df >= 1) & x.isNotNull(), p)


def friedman(scores: DataFrame, by: list[str], model: str = "model", blocks: tuple[str, ...] = ("repeat", "fold")) -> DataFrame:
    """Mean rank of every model (1: highest value) and the Friedman test over all of them, per group.

    A block counts if every model of the group has a value in it. Values are compared at nine
    digits; ties share their mean rank and the statistic is corrected for them. It is null when
    all values tie.
    """
    group = Window.partitionBy(*by)
    block = Window.partitionBy(*by, *blocks)
    known = scores.where(F.col("value").isNotNull()).withColumn("_v", F.round("value", 9))
    known = known.withColumn("models", F.size(F.collect_set(model).over(group)).cast("long"))
    known = known.withColumn("_in", F.count("*").over(block)).where(F.col("_in") == F.col("models"))
    tied = F.count("*").over(Window.partitionBy(*by, *blocks, "_v"))
    rank = F.rank().over(block.orderBy(F.desc("_v"))) + (tied - 1) / 2
    per_model = known.withColumn("_r", rank).groupBy(*by, model).agg(
        F.count("*").alias("n"), F.max("models").alias("models"), F.sum("_r").alias("_sum"), F.sum(F.col("_r") * F.col("_r")).alias("_sq")
    )
    n, k = F.col("n"), F.col("models")
    apart = F.col("_sum") - n * (k + 1) / 2
    spread = F.sum("_sq").over(group) - n * k * (k + 1) * (k + 1) / 4
    chi = F.when(F.abs(spread) > 1e-9, (k - 1) * F.sum(apart * apart).over(group) / spread)
    out = per_model.withColumn("chi_square", chi)
    return out.select(
        *by, model, "n", "models", (F.col("_sum") / n).alias("mean_rank"), "chi_square",
        chi_square_p(F.col("chi_square"), k - 1).alias("p"),
    )


def holm(tests: DataFrame, by: list[str], name: str, p: str = "p", adjusted: str = "p_holm") -> DataFrame:
    """Holm's correction of the p-values of a group: the running largest of p times the tests that are
    left, at most 1. Equal p-values go by ``name``; a test without a p-value is not counted."""
    group = Window.partitionBy(*by)
    upward = group.orderBy(F.col(p).isNull(), p, name)
    left = F.count(p).over(group) - F.row_number().over(upward) + 1
    tests = tests.withColumn(adjusted, F.when(F.col(p).isNotNull(), F.least(F.col(p) * left, F.lit(1.0))))
    largest = F.max(adjusted).over(upward.rowsBetween(Window.unboundedPreceding, 0))
    return tests.withColumn(adjusted, F.when(F.col(p).isNotNull(), largest))


def poisson_count(seed: object, *keys: str | Column) -> Column:
    """Poisson count of mean 1 that only depends on seed and keys."""
    u = F.conv(F.substring(keyed_md5(seed, *keys), 1, 8), 16, 10).cast("long") / F.lit(float(2**32))
    return F.size(F.filter(F.array(*[F.lit(c) for c in POISSON]), lambda c: c <= u))


def bootstrap_means(
    rows: DataFrame, by: list[str], value: str, entity: str,
    seed: object = 42, blocks: int = BLOCKS, draws: int = DRAWS, tail: float = TAIL,
) -> DataFrame:
    """Mean of ``value`` per group with a percentile interval over ``draws`` resamples of blocks.

    An entity is in one block, by its hash; a block counts as often as a Poisson count of mean 1
    says, which is the bootstrap for many blocks and adds up over parts. Rows without a value
    are left out; a draw without any row is, too.
    """
    sums = rows.where(F.col(value).isNotNull()).groupBy(*by, hash_bucket(seed, entity, buckets=blocks).alias("_block"))
    sums = sums.agg(F.count("*").alias("_n"), F.sum(value).alias("_s"))
    # A block's groups side by side, so that a count is drawn once for all of them.
    per_block = sums.groupBy("_block").agg(F.collect_list(F.struct(*by, "_n", "_s")).alias("_groups"))
    drawn = per_block.withColumn("_draw", F.explode(F.sequence(F.lit(0), F.lit(draws))))
    # Draw 0 is the data itself.
    weight = F.when(F.col("_draw") == 0, F.lit(1)).otherwise(poisson_count(seed, "_draw", "_block"))
    drawn = drawn.withColumn("_w", weight).where("_w > 0").select("_draw", "_w", F.inline("_groups"))
    means = drawn.groupBy(*by, "_draw").agg(
        F.sum(F.col("_w") * F.col("_n")).alias("_n"), F.sum(F.col("_w") * F.col("_s")).alias("_s")
    )
    means = means.withColumn("_m", F.try_divide("_s", F.col("_n")))
    resampled = F.when(F.col("_draw") > 0, F.col("_m"))
    own = lambda c: F.max(F.when(F.col("_draw") == 0, F.col(c)))
    return means.groupBy(*by).agg(
        own("_n").alias("n"), own("_m").alias("mean"), F.stddev_samp(resampled).alias("se"),
        F.percentile(resampled, F.lit(tail)).alias("low"), F.percentile(resampled, F.lit(1 - tail)).alias("high"),
    )
