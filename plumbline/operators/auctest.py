"""Uncertainty of the area under the ROC curve (E2, E4), by DeLong's structural components.

A positive's component is the share of negatives it beats, a negative's the share of
positives that beat it; a tie counts one half. Both follow from ranks: distinct scores are
counted by a partial aggregate, ordered inside cells, and cells are chained by running sums,
as for the area itself. The difference of two scores on the same records needs no
covariance: it is the variance of the components' differences, row by row.

Defined cases: a record without a score ranks below every score; with fewer than two records
of a class variance and interval are null; equal scores differ by 0 with error 0 and no z.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.scalars import with_fitted
from plumbline.operators import evaluate
from plumbline.operators.evaluate import UNSCORED, score_histogram, with_outside
from plumbline.operators.ranking import same_group

# Two-sided 95 % quantile of the normal distribution: the components' means are of many records.
Z95 = 1.959963984540054


def components(hist: DataFrame, by: list[str]) -> DataFrame:
    """The histogram with ``beats`` (share of negatives below) and ``beaten`` (share of positives above) per score."""
    all_ = hist.groupBy(*by).agg(F.sum("pos").alias("_p_all"), F.sum("neg").alias("_n_all"))
    inside = Window.partitionBy(*by, "_cell", "_fine").orderBy("_s")
    below = with_outside(hist, by)
    below = below.withColumns(
        {
            "_n_out": F.col("_n_out") + F.sum("neg").over(inside) - F.col("neg") / 2,
            "_p_out": F.col("_p_out") + F.sum("pos").over(inside) - F.col("pos") / 2,
        }
    )
    totals = with_fitted(below, all_.select(*by, F.struct("_p_all", "_n_all").alias("_t")), by, ["_t"])
    pos, neg = F.col("_t._p_all"), F.col("_t._n_all")
    return totals.select(
        *[f"`{c}`" for c in hist.columns],
        F.try_divide("_n_out", neg).alias("beats"),
        F.try_divide(pos - F.col("_p_out"), pos).alias("beaten"),
    )


def ranked_moments(hist: DataFrame, by: list[str]) -> DataFrame:
    """Cells with sums and sums of squares, over positives, of the negatives below them (``_won``)
    and, over negatives, of the positives below them (``_lost``); a tie counts one half.

    Moments of a cell follow from those inside it and the records in lower ones, so that no row
    is joined to what lies outside its cell. The variance of positives above a negative is that
    of positives below it.
    """
    d = lambda c: F.col(c).cast("double")
    sides = {"_won": ("pos", "neg"), "_lost": ("neg", "pos")}
    inside = Window.partitionBy("_step", *by).orderBy("_s")
    parts = hist.withColumns({f"_{c}_in": F.sum(c).over(inside) - d(c) / 2 for c in ("pos", "neg")})
    values = {"pos": F.col("pos"), "neg": F.col("neg")}
    for name, (own, other) in sides.items():
        values |= {name: d(own) * F.col(f"_{other}_in"), f"{name}2": d(own) * F.col(f"_{other}_in") * F.col(f"_{other}_in")}
    for cell, outer in (("_step", [*by, "_cell"]), ("_cell", by)):
        lower = Window.partitionBy(*outer).orderBy(cell).rowsBetween(Window.unboundedPreceding, -1)
        cells = parts.groupBy(cell, *by).agg(*[F.sum(c).alias(n) for n, c in values.items()])
        if cell == "_step":
            cells = cells.withColumn("_cell", F.floor(F.col("_step") / F.lit(evaluate.FINE)).cast("long"))
        values = {n: F.col(n) for n in values}
        below = {f"_{c}_out": F.coalesce(F.sum(c).over(lower), F.lit(0)).cast("double") for c in ("pos", "neg")}
        moved = {}
        for name, (own, other) in sides.items():
            out, n = F.col(f"_{other}_out"), d(own)
            moved |= {name: F.col(name) + out * n, f"{name}2": F.col(f"{name}2") + 2 * out * F.col(name) + out * out * n}
        parts = cells.withColumns(below).withColumns(moved).drop(*below)
    return parts


def _error(n_pos: Column, var_pos: Column, n_neg: Column, var_neg: Column) -> Column:
    return F.sqrt(F.greatest(F.try_divide(var_pos, n_pos) + F.try_divide(var_neg, n_neg), F.lit(0.0)))


def auc_interval(df: DataFrame, by: list[str], score: str = "s", y: str = "y") -> DataFrame:
    """Area, standard error and 95 % interval per group, from the histogram of scores alone."""
    cells = ranked_moments(score_histogram(df, by, score, y), by)
    whole = lambda c: F.sum(c).cast("double")
    n_pos, n_neg = whole("pos"), whole("neg")

    def spread(n: Column, m: Column, first: str, second: str) -> Column:
        """Variance of the ``n`` shares out of ``m``."""
        mean = F.try_divide(whole(first), n)
        return F.try_divide((whole(second) - n * mean * mean) / (m * m), n - 1)

    var_pos, var_neg = spread(n_pos, n_neg, "_won", "_won2"), spread(n_neg, n_pos, "_lost", "_lost2")
    out = cells.groupBy(*by).agg(
        F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"), F.try_divide(whole("_won"), n_pos * n_neg).alias("auc"),
        F.when((n_pos > 1) & (n_neg > 1), _error(n_pos, var_pos, n_neg, var_neg)).alias("se"),
    )
    return out.withColumns(
        {
            "low": F.greatest(F.col("auc") - Z95 * F.col("se"), F.lit(0.0)),
            "high": F.least(F.col("auc") + Z95 * F.col("se"), F.lit(1.0)),
        }
    )


def auc_differences(df: DataFrame, scores: dict[str, Column], base: str, y: str = "y") -> DataFrame:
    """Area of ``base`` minus that of every other score on the same records, with its error and z.

    Records shrink to counts of distinct (base, other) score pairs before they meet the
    components; a frequent score is split by the adaptive skew join.
    """
    others = [n for n in scores if n != base]
    fill = lambda c: F.coalesce(c, F.lit(UNSCORED))
    long = F.array(*[F.struct(F.lit(n).alias("variant"), scores[n].alias("s")) for n in scores])
    rows = df.where(F.col(y).isNotNull())
    parts = components(score_histogram(rows.select(y, F.inline(long)), ["variant"], "s", y), ["variant"])
    pairs = F.array(*[F.struct(F.lit(n).alias("versus"), fill(scores[n]).alias("b")) for n in others])
    counted = (
        rows.select(fill(scores[base]).alias("a"), F.col(y).alias("y"), F.inline(pairs))
        .groupBy("versus", "a", "b", "y")
        .agg(F.count("*").alias("k"))
    )
    part = parts.select("variant", "_s", "beats", "beaten")
    of_base = part.where(F.col("variant") == base).select(F.col("_s").alias("a"), *[F.col(c).alias(f"a_{c}") for c in ("beats", "beaten")])
    of_other = part.select(
        F.col("variant").alias("versus"), F.col("_s").alias("b"), *[F.col(c).alias(f"b_{c}") for c in ("beats", "beaten")]
    )
    both = counted.join(of_base, "a").join(of_other, ["versus", "b"])
    pick = lambda side: F.when(F.col("y") == 1, F.col(f"{side}_beats")).otherwise(F.col(f"{side}_beaten"))
    both = both.select("versus", "y", "k", pick("a").alias("va"), pick("b").alias("vb"))
    d = F.col("va") - F.col("vb")
    per_class = both.groupBy("versus", "y").agg(
        F.sum("k").alias("n"),
        F.sum(F.col("k") * F.col("va")).alias("sa"),
        F.sum(F.col("k") * F.col("vb")).alias("sb"),
        F.sum(F.col("k") * d).alias("sd"),
        F.sum(F.col("k") * d * d).alias("sdd"),
    )
    var = F.greatest(F.try_divide(F.col("sdd") - F.col("sd") * F.col("sd") / F.col("n"), F.col("n") - 1), F.lit(0.0))
    of = lambda c, value: F.max(F.when(F.col("y") == c, value))
    out = per_class.groupBy("versus").agg(
        of(1, F.col("n")).alias("n_pos"), of(0, F.col("n")).alias("n_neg"),
        of(1, F.col("sa") / F.col("n")).alias("auc"), of(1, F.col("sb") / F.col("n")).alias("auc_versus"),
        _error(of(1, F.col("n")).cast("double"), of(1, var), of(0, F.col("n")).cast("double"), of(0, var)).alias("se"),
    )
    diff = F.col("auc") - F.col("auc_versus")
    # Sums of squares leave about 1e-8 of an error that is 0.
    return out.withColumns(
        {"difference": diff, "low": diff - Z95 * F.col("se"), "high": diff + Z95 * F.col("se"),
         "z": F.when(F.col("se") > 1e-7, diff / F.col("se"))}
    )
