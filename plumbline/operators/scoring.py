"""Per-view scores from class-conditional Gaussians (M2), fitted by aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.scalars import logistic, long_features, total, with_scalar
from plumbline.spec import ViewSpec

MIN_VARIANCE = 1e-9


def class_statistics(train: DataFrame, features: list[str], y: str, by: list[str] = ()) -> DataFrame:
    """Count, mean and variance per feature and class, and the class counts.

    One shuffle of at most tasks x features x classes x groups small rows,
    whatever the size of ``train``.
    """
    long = long_features(train.where(F.col(y).isNotNull()), features, [*by, y])
    names = F.array(*[F.lit(f) for f in features])
    return (
        long.groupBy(*by, "_f", F.col(y).alias("class"))
        .agg(
            F.count("*").alias("n_class"),
            F.count("_x").alias("n"),
            F.avg("_x").alias("mean"),
            F.greatest(F.var_samp("_x"), F.lit(MIN_VARIANCE)).alias("var"),
        )
        .withColumn("feature", F.element_at(names, F.col("_f") + 1))
        .drop("_f")
    )


def fit_view_params(train: DataFrame, spec: ViewSpec, y: str = "y", by: list[str] = ()) -> DataFrame:
    """Class counts, and mean and variance per feature and class; one row per group.

    Pass rows of the training split only.
    """
    return params_wide(class_statistics(train, spec.features, y, by), spec, by)


def params_long(params: DataFrame, spec: ViewSpec, by: list[str] = ()) -> DataFrame:
    """Fitted parameters as (view, feature, class, mean, var, n) rows."""
    rows = F.array(
        *[
            F.struct(
                F.lit(v).alias("view"),
                F.lit(f).alias("feature"),
                F.lit(c).alias("class"),
                F.col(f"{f}__m{c}").alias("mean"),
                F.col(f"{f}__v{c}").alias("var"),
                F.col(f"{f}__n{c}").alias("n"),
                F.col(f"n{c}").alias("n_class"),
            )
            for v, f in spec.pairs
            for c in (0, 1)
        ]
    )
    return params.select(*by, F.inline(rows))


def wide_statistics(long: DataFrame, features: list[str], classes: list, by: list[str] = ()) -> DataFrame:
    """Class statistics side by side: ``n<j>``, ``<feature>__n<j>``, ``__m<j>``, ``__v<j>``.

    Reads one row per group, feature and class. A class that never occurs has
    count 0, no mean and the least variance.
    """
    aggs = []
    for j, c in enumerate(classes):
        of_class = F.col("class") == F.lit(c)
        aggs.append(F.coalesce(F.max(F.when(of_class, F.col("n_class"))), F.lit(0)).alias(f"n{j}"))
        for f in features:
            here = of_class & (F.col("feature") == f)
            pick = lambda name: F.max(F.when(here, F.col(name)))
            aggs += [
                F.coalesce(pick("n"), F.lit(0)).alias(f"{f}__n{j}"),
                pick("mean").alias(f"{f}__m{j}"),
                F.coalesce(pick("var"), F.lit(MIN_VARIANCE)).alias(f"{f}__v{j}"),
            ]
    return long.groupBy(*by).agg(*aggs)


def params_wide(long: DataFrame, spec: ViewSpec, by: list[str] = ()) -> DataFrame:
    """Inverse of ``params_long``, e.g. after reading a saved parameter table."""
    return wide_statistics(long, spec.features, [0, 1], by)


def merge_fold_params(
    stats: DataFrame, spec: ViewSpec, group: list[str], folds: str, trains: Column, model: str
) -> DataFrame:
    """Parameters of every model from per-fold parameters, without touching rows again.

    ``stats`` is ``fit_view_params(..., by=group+[folds])``; ``trains`` gives the
    array of models a fold trains. Means and variances are merged with the
    two-term formula around the pooled mean, which stays stable for features
    whose mean is large against their spread.
    """
    expanded = stats.withColumn(model, F.explode(trains))
    keys = [*group, model]
    pool = Window.partitionBy(*keys)
    means = {}
    for f in spec.features:
        for c in (0, 1):
            n, m = F.col(f"{f}__n{c}"), F.col(f"{f}__m{c}")
            means[f"{f}__mu{c}"] = F.try_divide(
                F.sum(n * m).over(pool), F.sum(F.when(m.isNotNull(), n)).over(pool)
            )
    expanded = expanded.withColumns(means)
    aggs = [F.sum(f"n{c}").alias(f"n{c}") for c in (0, 1)]
    for f in spec.features:
        for c in (0, 1):
            n, m, v, mu = (F.col(f"{f}__{k}{c}") for k in ("n", "m", "v", "mu"))
            spread = F.when(n > 1, (n - 1) * v).otherwise(F.lit(0.0)) + n * (m - mu) * (m - mu)
            aggs += [
                F.sum(n).alias(f"{f}__n{c}"),
                F.max(mu).alias(f"{f}__m{c}"),
                F.greatest(
                    F.try_divide(F.sum(spread), F.sum(n) - 1), F.lit(MIN_VARIANCE)
                ).alias(f"{f}__v{c}"),
            ]
    return expanded.groupBy(*keys).agg(*aggs)


def score_constants(params: DataFrame, spec: ViewSpec, by: list[str] = ()) -> DataFrame:
    """What a row needs from the fitted parameters, derived once per parameter row.

    Logarithms and divisions leave the per-row expression, which also keeps the
    generated code small enough to be compiled natively. A feature that a class
    never showed gets zero terms.
    """
    out = [F.ln(F.col("n1") / F.nullif(F.col("n0"), F.lit(0))).alias("prior")]
    for f in spec.features:
        m0, m1, v0, v1 = (F.col(f"{f}__{k}") for k in ("m0", "m1", "v0", "v1"))
        known = m0.isNotNull() & m1.isNotNull()
        terms = {
            "c": F.lit(0.5) * F.ln(v0 / v1),
            "m0": m0,
            "m1": m1,
            "h0": F.lit(0.5) / v0,
            "h1": F.lit(0.5) / v1,
        }
        out += [F.when(known, t).otherwise(F.lit(0.0)).alias(f"{f}__{k}") for k, t in terms.items()]
    return params.select(*by, *out)


def view_score(spec: ViewSpec, view: str, constants: str = "_P") -> Column:
    """Probability of class 1 from the view's valid features; null if none is valid."""
    terms = []
    for f in spec.views[view]:
        x = F.col(f)
        c, m0, m1, h0, h1 = (F.col(f"{constants}.{f}__{k}") for k in ("c", "m0", "m1", "h0", "h1"))
        terms.append(F.coalesce(c + (x - m0) * (x - m0) * h0 - (x - m1) * (x - m1) * h1, F.lit(0.0)))
    seen = F.coalesce(*[F.col(f) for f in spec.views[view]]).isNotNull()
    return F.when(seen, logistic(F.col(f"{constants}.prior") + total(terms)))


def with_scores(df: DataFrame, spec: ViewSpec, constants: str = "_P") -> DataFrame:
    return df.withColumns({f"p_{v}": view_score(spec, v, constants) for v in spec.names})


def score_views(df: DataFrame, spec: ViewSpec, params: DataFrame) -> DataFrame:
    """Adds ``p_<view>`` from a one-row parameter table."""
    return with_scores(with_scalar(df, score_constants(params, spec), "_P"), spec).drop("_P")


def fit_class_params(train: DataFrame, features: list[str], classes: list[str], cls: str) -> DataFrame:
    """One-row Gaussian parameters for several classes (``classes`` is declared)."""
    return wide_statistics(class_statistics(train, features, cls), features, classes)


def predict_class(
    df: DataFrame, features: list[str], classes: list[str], params: DataFrame, name: str = "yhat"
) -> DataFrame:
    """Class with the highest log posterior; the earlier class wins a tie."""
    df = with_scalar(df, params, "_C")
    logits = {}
    for j in range(len(classes)):
        terms = []
        for f in features:
            x, m, v = F.col(f), F.col(f"_C.{f}__m{j}"), F.col(f"_C.{f}__v{j}")
            terms.append(F.coalesce(F.lit(-0.5) * F.ln(v) - (x - m) * (x - m) / (2 * v), F.lit(0.0)))
        logits[f"_l{j}"] = F.ln(F.col(f"_C.n{j}")) + total(terms)
    df = df.withColumns(logits)
    best = F.greatest(*[F.col(c) for c in logits])
    pick = F.lit(None).cast("string")
    for j in reversed(range(len(classes))):
        pick = F.when(F.col(f"_l{j}") == best, F.lit(classes[j])).otherwise(pick)
    return df.withColumn(name, pick).drop("_C", *logits)
