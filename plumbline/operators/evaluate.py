"""Evaluation utilities (E1-E3) and the decision threshold (M3).

Ranking is exact: every distinct score counts. Scores are counted by a partial
aggregate, ranked inside fine cells, and fine cells and cells are chained by
running sums, so that no task sorts a whole group. Cells are steps of log-odds:
scores that pile up near 0 or 1 spread over them as those in the middle do. A
record without a score was not detected: it ranks below every score and no
threshold reaches it.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.scalars import with_fitted
from plumbline.operators.ranking import same_group
from plumbline.session import stage

# Cells in one unit of log-odds, and fine cells in each. Log-odds of doubles lie between -745
# and 37, so a running sum over a group's cells reads at most 800,000 rows. A group has about a
# million fine cells to a unit of log-odds, whatever the number of its records.
CELLS, FINE = 1 << 10, 1 << 10
# Stands for a missing score; scores are probabilities.
UNSCORED = -1.0


def confusion(df: DataFrame, y: str = "y", pred: str = "pred", by: list[str] = ()) -> DataFrame:
    cell = lambda a, b: F.count(F.when((F.col(y) == a) & (F.col(pred) == b), 1))
    return df.groupBy(*by).agg(
        cell(1, 1).alias("tp"), cell(0, 1).alias("fp"), cell(0, 0).alias("tn"), cell(1, 0).alias("fn")
    )


def rates(counts: DataFrame) -> DataFrame:
    """Rates from confusion counts; a rate with an empty base is null."""
    tp, fp, tn, fn = (F.col(c).cast("double") for c in ("tp", "fp", "tn", "fn"))
    recall = F.try_divide(tp, tp + fn)
    specificity = F.try_divide(tn, tn + fp)
    return counts.withColumns(
        {
            "accuracy": F.try_divide(tp + tn, tp + fp + tn + fn),
            "precision": F.try_divide(tp, tp + fp),
            "recall": recall,
            "specificity": specificity,
            "f1": F.try_divide(2 * tp, 2 * tp + fp + fn),
            "balanced_accuracy": (recall + specificity) / 2,
            "mcc": F.try_divide(
                tp * tn - fp * fn,
                F.sqrt(tp + fp) * F.sqrt(tp + fn) * F.sqrt(tn + fp) * F.sqrt(tn + fn),
            ),
        }
    )


def _counted(cond: Column) -> Column:
    return F.count(F.when(cond, 1))


def score_cells(score: str | Column) -> tuple[Column, Column]:
    """Cell and fine cell of a score; together they never fall as the score rises.

    Scores below 0 have the lowest cell, those of at least 1 the highest.
    """
    return _cells_of(score_step(F.col(score) if isinstance(score, str) else score))


def score_step(s: Column) -> Column:
    """Number of a score's fine cell, counted through all cells."""
    odds = F.when((s > 0) & (s < 1), F.try_divide(s, 1 - s))
    step = F.floor(F.log(odds) * F.lit(float(CELLS * FINE)))
    return F.when(s < 0, F.lit(-900 * CELLS * FINE)).when(s == 0, F.lit(-800 * CELLS * FINE)).when(
        s < 1, step
    ).otherwise(F.lit(100 * CELLS * FINE)).cast("long")


def _cells_of(step: Column) -> tuple[Column, Column]:
    return F.floor(step / F.lit(FINE)).cast("long"), F.pmod(step, F.lit(FINE)).cast("int")


def score_histogram(
    df: DataFrame, by: list[str], score: str = "s", y: str = "y", also: list[Column] = ()
) -> DataFrame:
    """Positive and negative records per group and distinct score ``_s``, with its ``_cell`` and ``_fine``
    cell and ``_step``, which is both.

    The cells follow from the score and are added after it was counted: they are not shuffled.
    """
    s = F.coalesce(F.col(score), F.lit(UNSCORED))
    step = score_step(F.col("_s"))
    cell, fine = _cells_of(F.col("_step"))
    return (
        df.where(F.col(y).isNotNull())
        .groupBy(*by, s.alias("_s"))
        .agg(_counted(F.col(y) == 1).alias("pos"), _counted(F.col(y) == 0).alias("neg"), *also)
        .withColumn("_step", step)
        .withColumns({"_cell": cell, "_fine": fine})
    )


def with_outside(hist: DataFrame, by: list[str], above: bool = False) -> DataFrame:
    """The histogram with ``_p_out`` and ``_n_out``: records of a group in lower (or higher) fine cells."""
    sums = [F.sum("pos").alias("_p"), F.sum("neg").alias("_n")]
    order = F.desc if above else F.asc
    before = lambda keys, cell: Window.partitionBy(*keys).orderBy(order(cell)).rowsBetween(Window.unboundedPreceding, -1)
    summed = lambda c, w: F.coalesce(F.sum(c).over(w), F.lit(0))
    fine = hist.groupBy(*by, "_cell", "_fine").agg(*sums)
    inside, outside = before([*by, "_cell"], "_fine"), before(by, "_cell")
    cells = hist.groupBy(*by, "_cell").agg(*sums)
    fine = fine.select(*by, "_cell", "_fine", summed("_p", inside).alias("_p_in"), summed("_n", inside).alias("_n_in"))
    cells = cells.select(*by, "_cell", summed("_p", outside).alias("_p_out"), summed("_n", outside).alias("_n_out"))
    fine = fine.alias("f").join(cells.alias("c"), same_group("f", "c", [*by, "_cell"])).select(
        "f.*", (F.col("_p_in") + F.col("_p_out")).alias("_p_out"), (F.col("_n_in") + F.col("_n_out")).alias("_n_out")
    )
    joined = hist.alias("h").join(fine.alias("f"), same_group("h", "f", [*by, "_cell", "_fine"]))
    return joined.select("h.*", "f._p_out", "f._n_out")


def ranked(
    hist: DataFrame, by: list[str], sums: Mapping[str, Column] | None = None, series: tuple[str, ...] = ("",)
) -> DataFrame:
    """Cells with the pairs they win (``_wins``: a positive above a negative is one, a tie a half).

    ``sums`` names further values of a row of the histogram to be summed; they are derived after
    the rows were sorted, so that the shuffle does not carry them. ``series`` are endings of the columns ``pos``, ``neg`` and ``_wins``: several countings of
    the same scores are ranked by one sort.
    """
    # The step comes first: rows are told apart by one number, before any text of ``by``.
    inside = Window.partitionBy("_step", *by).orderBy("_s")
    wins = lambda x, below: F.col(f"pos{x}").cast("double") * below
    neg = lambda x: F.col(f"neg{x}")
    won = hist.withColumns({f"_wins{x}": wins(x, F.sum(neg(x)).over(inside) - neg(x) / 2) for x in series})
    values = {f"{c}{x}": F.col(f"{c}{x}") for c in ("pos", "neg", "_wins") for x in series}
    values.update(sums or {})
    for cell, outer in (("_step", [*by, "_cell"]), ("_cell", by)):
        lower = Window.partitionBy(*outer).orderBy(cell).rowsBetween(Window.unboundedPreceding, -1)
        cells = won.groupBy(cell, *by).agg(*[F.sum(c).alias(n) for n, c in values.items()])
        if cell == "_step":
            cells = cells.withColumn("_cell", _cells_of(F.col("_step"))[0])
        values = {n: F.col(n) for n in values}
        more = {x: wins(x, F.coalesce(F.sum(neg(x)).over(lower), F.lit(0))) for x in series}
        won = cells.withColumns({f"_wins{x}": F.col(f"_wins{x}") + m for x, m in more.items()})
    return won


def _auc() -> Column:
    both = F.sum("pos").cast("double") * F.sum("neg").cast("double")
    return F.try_divide(F.sum("_wins"), both)


def auc(df: DataFrame, by: list[str] = (), score: str = "s", y: str = "y") -> DataFrame:
    """Area under the ROC curve; tied scores count one half."""
    hist = score_histogram(df, list(by), score, y)
    return ranked(hist, list(by)).groupBy(*by).agg(_auc().alias("auc"))


def metrics(
    df: DataFrame, by: list[str], theta: str = "theta", score: str = "s", y: str = "y"
) -> DataFrame:
    """Counts, rates, AUC and Brier score per group; the threshold is a column.

    A record without a score counts as not detected, and in ``n_unscored``. The
    Brier score is that of the scored records.
    """
    names, over = ("tp", "fp", "_sse", "n_unscored"), lambda s: F.coalesce(s >= F.col(theta), F.lit(False))
    if theta in by:
        # Rows of a group share the threshold: everything follows from the counts of a score.
        s, pos, neg = F.col("_s"), F.col("pos"), F.col("neg")
        none = s == UNSCORED
        hit = ~none & over(s)
        miss = F.when(~none, pos * (1 - s) * (1 - s) + neg * s * s)
        values = (F.when(hit, pos).otherwise(0), F.when(hit, neg).otherwise(0), miss, F.when(none, pos + neg).otherwise(0))
        return totals(ranked(score_histogram(df, by, score, y), by, dict(zip(names, values))), by)
    hit, miss = over(F.col(score)), F.col(score) - F.col(y)
    hist = score_histogram(
        df,
        by,
        score,
        y,
        [
            _counted((F.col(y) == 1) & hit).alias("tp"),
            _counted((F.col(y) == 0) & hit).alias("fp"),
            F.sum(miss * miss).alias("_sse"),
            _counted(F.col(score).isNull()).alias("n_unscored"),
        ],
    )
    return totals(ranked(hist, by, {c: F.col(c) for c in names}), by)


def totals(cells: DataFrame, by: list[str]) -> DataFrame:
    """Counts, rates, AUC and Brier score per group of ranked cells."""
    n = F.sum(F.col("pos") + F.col("neg"))
    counts = cells.groupBy(*by).agg(
        n.alias("n"),
        F.sum("n_unscored").alias("n_unscored"),
        F.sum("tp").alias("tp"),
        F.sum("fp").alias("fp"),
        F.sum(F.col("neg") - F.col("fp")).alias("tn"),
        F.sum(F.col("pos") - F.col("tp")).alias("fn"),
        _auc().alias("auc"),
        F.try_divide(F.sum("_sse"), n - F.sum("n_unscored")).alias("brier"),
    )
    return rates(counts)


def _worth(metric: str, tp: Column, fp: Column, pos: Column, neg: Column) -> Column:
    if metric == "youden":
        value = F.try_divide(tp, pos) - F.try_divide(fp, neg)
    elif metric == "f1":
        value = F.try_divide(2 * tp, tp + fp + pos)
    else:
        raise ValueError(f"unknown metric {metric!r}")
    return F.coalesce(F.round(value, 9), F.lit(-1.0))


def _open_cells(val: DataFrame, by: list[str], score: str, y: str, metric: str) -> DataFrame:
    """The fine cells (``_step``) that may hold a group's best threshold, with the records above and of the group.

    A fine cell's lowest score is worth what its counts say; a higher one of it at most what all
    of its positives without its negatives would be. Fine cells that cannot beat the best lowest
    score are left out, and those that only equal it if they are higher.
    """
    s = F.coalesce(F.col(score), F.lit(UNSCORED))
    fine = (
        val.where(F.col(y).isNotNull())
        .groupBy(*by, score_step(s).alias("_step"))
        .agg(_counted(F.col(y) == 1).alias("_p"), _counted(F.col(y) == 0).alias("_n"))
        .withColumn("_cell", _cells_of(F.col("_step"))[0])
    )
    down, whole = Window.partitionBy(*by).orderBy(F.desc("_cell")), Window.partitionBy(*by)
    outside = down.rowsBetween(Window.unboundedPreceding, -1)
    cells = fine.groupBy(*by, "_cell").agg(F.sum("_p").alias("_p"), F.sum("_n").alias("_n"))
    cells = cells.select(
        *[F.col(c).alias(f"_by_{c}") for c in by],
        F.col("_cell").alias("_by__cell"),
        F.coalesce(F.sum("_p").over(outside), F.lit(0)).alias("_p_out"),
        F.coalesce(F.sum("_n").over(outside), F.lit(0)).alias("_n_out"),
        F.sum("_p").over(whole).alias("p_all"),
        F.sum("_n").over(whole).alias("n_all"),
    )
    inside = Window.partitionBy(*by, "_cell").orderBy(F.desc("_step")).rowsBetween(Window.unboundedPreceding, 0)
    fine = fine.withColumns({"_p_upto": F.sum("_p").over(inside), "_n_upto": F.sum("_n").over(inside)})
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_by_{c}")) for c in (*by, "_cell")])
    p, n = F.col("_p_upto") + F.col("_p_out"), F.col("_n_upto") + F.col("_n_out")
    worth = lambda tp, fp: _worth(metric, tp, fp, F.col("p_all"), F.col("n_all"))
    tried = fine.where(F.col("_step") >= F.lit(-800 * CELLS * FINE)).join(cells, same).select(
        *by, "_step", (p - F.col("_p")).alias("p_above"), (n - F.col("_n")).alias("n_above"), "p_all", "n_all",
        worth(p, n).alias("_edge"), worth(p, n - F.col("_n")).alias("_most"),
    )
    lead = F.struct("_edge", -F.col("_step"))
    best = tried.groupBy(*by).agg(F.max_by(F.struct("_edge", "_step"), lead).alias("_best"))
    tried = with_fitted(tried, best, by, ["_best"])
    level = F.col("_best._edge")
    open_ = (F.col("_most") > level) | ((F.col("_most") == level) & (F.col("_step") <= F.col("_best._step")))
    return tried.where(open_).select(*by, "_step", F.struct("p_above", "n_above", "p_all", "n_all").alias("_r"))


def fit_threshold(
    val: DataFrame, by: list[str] = (), score: str = "s", y: str = "y", metric: str = "youden"
) -> DataFrame:
    """M3: the score that is the best threshold on validation rows.

    Every distinct score is a candidate; a tie goes to the lowest. Fine cells are counted
    first, which shuffles no more than their counts; then only the scores of the few that
    may hold the best one are ranked.
    """
    by = list(by)
    keys = by or ["_all"]
    # As the output of a generator the score is computed once, however often it is used below.
    pair = F.inline(F.array(F.struct(F.col(score).alias("_score"), F.col(y).alias("_y"))))
    val = val.select(*by, *[F.lit(0).alias(k) for k in keys if k not in by], pair)
    score, y = "_score", "_y"
    found = stage(_open_cells(val, keys, score, y, metric), "open_cells")
    found = found.select(*[F.col(k).alias(f"_by_{k}") for k in (*keys, "_step")], "_r")
    near = val.withColumn("_step", score_step(F.coalesce(F.col(score), F.lit(UNSCORED))))
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_by_{k}")) for k in (*keys, "_step")])
    hist = score_histogram(near.join(found, same), keys, score, y, [F.first("_r").alias("_r")])
    down = Window.partitionBy(*keys, "_cell", "_fine").orderBy(F.desc("_s"))
    tp = F.col("_r.p_above") + F.sum("pos").over(down)
    fp = F.col("_r.n_above") + F.sum("neg").over(down)
    tried = hist.withColumn("_value", _worth(metric, tp, fp, F.col("_r.p_all"), F.col("_r.n_all")))
    best = F.min_by(
        F.struct(F.col("_s").alias("theta"), F.col("_value").alias("value")),
        F.struct(-F.col("_value"), F.col("_s")),
    )
    return tried.groupBy(*keys).agg(best.alias("_b")).select(*by, F.col("_b.theta").alias("theta"), F.col("_b.value").alias(metric))


def per_class(df: DataFrame, y: str = "y", pred: str = "yhat") -> DataFrame:
    """Support, precision, recall and F1 per class (the window reads classes² rows)."""
    cells = df.groupBy(F.col(y).alias("_y"), F.col(pred).alias("_p")).agg(F.count("*").alias("_n"))
    sides = cells.select(
        F.inline(
            F.array(
                F.struct(
                    F.col("_y").alias("class"),
                    F.col("_n").alias("support"),
                    F.lit(0).cast("long").alias("predicted"),
                    F.when(F.col("_y") == F.col("_p"), F.col("_n")).otherwise(0).alias("hits"),
                ),
                F.struct(
                    F.col("_p").alias("class"),
                    F.lit(0).cast("long").alias("support"),
                    F.col("_n").alias("predicted"),
                    F.lit(0).cast("long").alias("hits"),
                ),
            )
        )
    )
    hits = F.col("hits").cast("double")
    return (
        sides.groupBy("class")
        .agg(*[F.sum(c).alias(c) for c in ("support", "predicted", "hits")])
        .withColumns(
            {
                "precision": F.try_divide(hits, F.col("predicted")),
                "recall": F.try_divide(hits, F.col("support")),
                "f1": F.try_divide(2 * hits, F.col("predicted") + F.col("support")),
            }
        )
    )
