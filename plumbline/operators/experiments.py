"""Validation, ablation, degradation, cross-dataset and repeated-CV runs.

Variants, degradation rates and roles are literal arrays exploded inside the
scan stage. One pass evaluates all of them and every shuffle carries only counted
scores or class statistics.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from itertools import pairwise

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.scalars import hash_bucket, total, with_fitted, with_scalar
from plumbline.operators import logistic
from plumbline.operators.evaluate import UNSCORED, totals
from plumbline.operators.fusion import fit_alpha, fit_view_weights, fuse, fused, unweighted, weight_columns
from plumbline.operators.scoreranges import gathered, measures, thresholds
from plumbline.operators.scoring import (
    fit_view_params,
    merge_fold_params,
    score_constants,
    view_score,
    with_scores,
)
from plumbline.operators.views import with_quality
from plumbline.session import stage
from plumbline.spec import ViewSpec


def score_variants(df: DataFrame, variants: Mapping[str, Column], keep: list[str]) -> DataFrame:
    """One row per variant with its score ``s``.

    Scores are columns before they become rows: a stage too long for compiled code evaluates
    what stands inside a generator piece by piece.
    """
    scores = {n: f"_s_{k}" for k, n in enumerate(variants)}
    df = df.select(*keep, *[variants[n].alias(c) for n, c in scores.items()])
    rows = F.array(
        *[F.struct(F.lit(n).alias("variant"), F.col(c).alias("s")) for n, c in scores.items()]
    )
    return df.select(*keep, F.inline(rows))


def variant_columns(df: DataFrame, variants: Mapping[str, Column]) -> tuple[DataFrame, dict[str, str]]:
    """Scores as columns beside the others, and the column of each variant."""
    names = {n: f"_s_{k}" for k, n in enumerate(variants)}
    return df.withColumns({c: variants[n] for n, c in names.items()}), names


def variant_thresholds(val: DataFrame, variants: Mapping[str, Column], by: list[str] = ()) -> DataFrame:
    """``variant``, ``theta`` and its Youden index, from validation rows."""
    scored = lambda rows: variant_columns(rows, variants)[0]
    return thresholds(val, scored, list(by), variant_columns(val, variants)[1])


def compare(val: DataFrame, test: DataFrame, variants: Mapping[str, Column], by: list[str] = ()) -> DataFrame:
    """Metrics of every variant on ``test``, with its threshold from ``val``."""
    theta = variant_thresholds(val, variants, by)
    scored = lambda rows: variant_columns(rows, variants)[0]
    return measures(test, scored, list(by), variant_columns(test, variants)[1], theta)


def standard_variants(spec: ViewSpec) -> dict[str, Column]:
    """Every single view, the plain mean, and the fused score ``s``."""
    return {
        **{f"view:{v}": F.col(f"p_{v}") for v in spec.names},
        "unweighted": unweighted(spec),
        "reliability": F.col("s"),
    }


def gaussian_baseline(spec: ViewSpec, constants: str = "_P") -> Column:
    """A conventional model on all features at once, from the same class statistics."""
    return view_score(ViewSpec({"all": tuple(spec.features)}), "all", constants)


def validate_views(val: DataFrame, test: DataFrame, spec: ViewSpec) -> DataFrame:
    """All variants side by side; each threshold comes from validation rows."""
    return compare(val, test, standard_variants(spec))


def ablation_variants(spec: ViewSpec) -> list[dict[str, object]]:
    """Component switches: factor flags, global weights, and one view left out."""
    on = {"f_i": 1.0, "f_q": 1.0, "f_t": 1.0, "f_g": 1.0, "without": ""}
    return [
        {"variant": "full", **on},
        {"variant": "no_integrity", **on, "f_i": 0.0},
        {"variant": "no_quality", **on, "f_q": 0.0},
        {"variant": "no_temporal", **on, "f_t": 0.0},
        {"variant": "no_reliability", **on, "f_i": 0.0, "f_q": 0.0, "f_t": 0.0},
        {"variant": "no_weights", **on, "f_g": 0.0},
        {"variant": "unweighted", "f_i": 0.0, "f_q": 0.0, "f_t": 0.0, "f_g": 0.0, "without": ""},
        *[{"variant": f"without:{v}", **on, "without": v} for v in spec.names],
    ]


def ablation_columns(
    df: DataFrame, spec: ViewSpec, g: dict[str, Column], alpha: tuple[Column, Column, Column]
) -> tuple[DataFrame, dict[str, str]]:
    """The score of every variant as a column, and their names. A switched-off factor leaves the mean
    of the remaining ones; with all three off, reliability is 1."""
    weight, base, names, scores = {}, {}, {}, {}
    for k, variant in enumerate(ablation_variants(spec)):
        on = {f: F.lit(variant[f"f_{f}"]) * c for f, c in zip("iqt", alpha)}
        base[f"_base_{k}"] = F.nullif(total(list(on.values())), F.lit(0.0))
        for v in spec.names:
            mix = on["i"] * F.col("i") + on["q"] * F.col(f"q_{v}") + on["t"] * F.col("t")
            r = F.coalesce(mix / F.col(f"_base_{k}"), F.lit(1.0))
            used = F.lit(0.0) if variant["without"] == v else (g[v] if variant["f_g"] else F.lit(1.0)) * r
            weight[f"_w_{k}_{v}"] = F.when(F.col(f"p_{v}").isNotNull(), used)
        up = total([F.coalesce(F.col(f"_w_{k}_{v}") * F.col(f"p_{v}"), F.lit(0.0)) for v in spec.names])
        down = total([F.coalesce(F.col(f"_w_{k}_{v}"), F.lit(0.0)) for v in spec.names])
        names[variant["variant"]] = f"_s_{k}"
        scores[f"_s_{k}"] = F.try_divide(up, down)
    return df.withColumns(base).withColumns(weight).withColumns(scores), names


def ablation_scores(
    df: DataFrame, spec: ViewSpec, g: dict[str, Column], alpha: tuple[Column, Column, Column], keep: list[str]
) -> DataFrame:
    """One row per record and variant."""
    scored, names = ablation_columns(df, spec, g, alpha)
    rows = F.array(*[F.struct(F.lit(n).alias("variant"), F.col(c).alias("s")) for n, c in names.items()])
    return scored.select(*keep, F.inline(rows))


def ablate(
    val: DataFrame,
    test: DataFrame,
    spec: ViewSpec,
    g: dict[str, Column],
    alpha: tuple[Column, Column, Column],
) -> DataFrame:
    """E5: metrics of every component variant on clean rows, each with its own threshold."""
    names = ablation_columns(val, spec, g, alpha)[1]
    scored = lambda rows: ablation_columns(rows, spec, g, alpha)[0]
    theta = thresholds(val, scored, [], names)
    return measures(test, scored, [], names, theta)


def degradation_draw(seed: object, view: Column, key: str = "record_id") -> Column:
    """Number in [0, 1000) that decides from which rate on a record's view is hit."""
    return hash_bucket(seed, view, key, buckets=1000)


def degrade(
    df: DataFrame,
    spec: ViewSpec,
    view: Column,
    rate: Column,
    seed: object,
    key: str = "record_id",
    mode: str = "drop",
    scale: Mapping[str, Column] | None = None,
    draw: Column | None = None,
) -> DataFrame:
    """Drop or perturb a view's features for a share ``rate`` of the records.

    Which records are hit depends only on seed, view and key, so the records hit
    at a low rate are hit at every higher one; 0 leaves all, 1 hits all. Noise
    is uniform in ``[-scale, scale]``. ``draw`` is the result of ``degradation_draw``
    where the caller has it already.
    """
    if draw is None:
        draw = degradation_draw(seed, view, key)
    df = df.withColumn("_hit", draw < rate * 1000)
    changed = {}
    for v, fs in spec.views.items():
        for f in fs:
            hit = F.col("_hit") & (view == v)
            if mode == "drop":
                new = F.lit(None).cast("double")
            elif mode == "noise":
                u = hash_bucket(seed, F.lit(f), key, buckets=1_000_000) / F.lit(1e6)
                new = F.col(f) + scale[f] * (2 * u - 1)
            else:
                raise ValueError(f"unknown mode {mode!r}")
            changed[f] = F.when(hit, new).otherwise(changed.get(f, F.col(f)))
    return df.withColumns(changed).drop("_hit")


RATES = (0.0, 0.25, 0.5, 0.75, 1.0)
# Scores of a model and view that one task ranks, test rows whose scores bound these ranges, and
# rows that a task counts at once.
RANGE, BOUNDING, CHUNK = 1 << 19, 20_000, 200_000


def degradation_curve(
    test: DataFrame,
    spec: ViewSpec,
    g: dict[str, Column],
    alpha: tuple[object, object, object],
    theta: DataFrame,
    seed: object,
    constants: str = "_P",
    rates: tuple[float, ...] = RATES,
    baselines: Mapping[str, Column] | None = None,
    mode: str = "drop",
    scale: Mapping[str, Column] | None = None,
    key: str = "record_id",
) -> DataFrame:
    """Both fusions, and models without views (``baselines``: name and score of a row),
    under every (view, rate), and the loss against the lowest rate.

    A view of a record is hit or not, whatever the rate, so a record is scored clean once and
    once per view. Its two scores for a view count at the rates below and from its first hit
    on; all rates are ranked by one sort. ``theta`` has the threshold of each model, fitted on
    clean validation rows.

    Scores are dealt to ranges of like size, whose bounds a sample gives; every score is then
    counted and ranked in its range, and the few ranges are chained by running sums.
    """
    rates = tuple(sorted(rates))
    firsts = {}
    for v in spec.names:
        draw = degradation_draw(seed, F.lit(v), key)
        firsts[f"_first_{v}"] = total([F.when(draw < F.lit(r * 1000), 0).otherwise(1) for r in rates])
    variants = {"unweighted": unweighted(spec), "reliability": F.col("s"), **(baselines or {})}
    scores = {n: f"_s{k}" for k, n in enumerate(variants)}

    def scored(rows: DataFrame) -> DataFrame:
        """A row per record and state (``_at``: 0 clean, else the number of the view that is hit)."""
        states = F.posexplode(F.array(*[F.lit(v) for v in ("", *spec.names)])).alias("_at", "_state")
        rows = rows.withColumns(firsts).select("*", states)
        hit = degrade(rows, spec, F.col("_state"), F.lit(1.0), seed, key, mode, scale, draw=F.lit(0))
        out = fuse(with_quality(with_scores(hit, spec, constants), spec), spec, g, alpha)
        ranks = [F.coalesce(variants[n], F.lit(UNSCORED)).alias(c) for n, c in scores.items()]
        return out.select("_at", F.col("y").cast("int").alias("y"), *firsts, *ranks)

    rows = test.where(F.col("y").isNotNull())
    n = rows.count()
    ranges, bounds = -(-2 * n // RANGE), {}
    if ranges > 1:
        own = F.when(F.col("_at") > 0, F.array("_at")).otherwise(F.array(*[F.lit(j + 1) for j in range(len(spec.names))]))
        some = scored(rows.sample(min(1.0, BOUNDING / n), 42)).select(F.explode(own).alias("_view"), *scores.values())
        cuts = [F.percentile_approx(c, [j / ranges for j in range(1, ranges)], 10_000).alias(c) for c in scores.values()]
        for r in some.groupBy("_view").agg(*cuts).collect():
            bounds.update({(n, r["_view"]): np.unique(r[c]) for n, c in scores.items()})
    views = list(enumerate(spec.names, 1))

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in gathered(batches, CHUNK):
            at, y = rows["_at"].to_numpy(), rows["y"].to_numpy()
            kind = np.where(y == 1, 1, np.where(y == 0, 0, 2))
            out = []
            for j, view in views:
                first = rows[f"_first_{view}"].to_numpy()
                mine = np.flatnonzero(((at == 0) & (first > 0)) | ((at == j) & (first < len(rates))))
                code = ((at[mine] > 0) * 3 + kind[mine]) * (len(rates) + 1) + first[mine]
                for name, c in scores.items():
                    s, codes, counts = _counted_scores(rows[c].to_numpy()[mine], code)
                    edges = np.searchsorted(s, bounds.get((name, j), []))
                    for part, (low, high) in enumerate(pairwise([0, *edges, len(s)])):
                        if low < high:
                            out.append((name, view, part, s[low:high], codes[low:high], counts[low:high]))
            yield pd.DataFrame(out, columns=["variant", "view", "part", "s", "code", "count"])

    def rank(part: pd.DataFrame) -> pd.DataFrame:
        return _ranked_range(part, rates)

    by = ["variant", "view"]
    kinds = "variant string, view string, part int, s array<double>, code array<int>, count array<int>"
    dealt = with_fitted(scored(rows).mapInPandas(deal, kinds), theta, ["variant"], ["theta"])
    kinds = "variant string, view string, part int, rate double, pos long, neg long, _wins double, tp long, fp long, _sse double, n_unscored long"
    cells = dealt.groupBy(*by, "part").applyInPandas(rank, kinds)
    lower = Window.partitionBy(*by, "rate").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    below = F.col("pos").cast("double") * F.coalesce(F.sum("neg").over(lower), F.lit(0))
    curve = totals(cells.withColumn("_wins", F.col("_wins") + below), [*by, "rate"])
    # One row per declared variant, view and rate is left here.
    clean = Window.partitionBy(*by).orderBy("rate")
    return curve.withColumns(
        {
            "auc_loss": F.first("auc").over(clean) - F.col("auc"),
            "brier_rise": F.col("brier") - F.first("brier").over(clean),
        }
    )


def _counted_scores(s: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (score, code) by rising score, and how often each occurs; a NaN, as Spark has it, is the highest."""
    s = np.where(np.isnan(s), np.inf, s)
    order = np.lexsort((code, s))
    s, code = s[order], code[order]
    new = np.flatnonzero(np.r_[True, (s[1:] != s[:-1]) | (code[1:] != code[:-1])][: len(s)])
    return s[new], code[new].astype(np.int32), np.diff(np.r_[new, len(s)]).astype(np.int32)


def _ranked_range(part: pd.DataFrame, rates: tuple[float, ...]) -> pd.DataFrame:
    """Counts of every rate in one range of scores, and the pairs that are won inside it."""
    s, code, count = (np.concatenate(part[c].to_list()) for c in ("s", "code", "count"))
    order = np.argsort(s)
    s, code, count = s[order], code[order], count[order].astype(np.int64)
    kind, first = np.divmod(code, len(rates) + 1)
    starts = np.flatnonzero(np.r_[True, s[1:] != s[:-1]])
    u = s[starts]
    over, none = u >= part["theta"].iloc[0], u == UNSCORED
    u = np.where(np.isinf(u), np.nan, u)
    out = []
    for j, rate in enumerate(rates):
        here = np.where(np.where(kind >= 3, first <= j, first > j), count, 0)
        pos, neg = (np.add.reduceat(np.where(kind % 3 == c, here, 0), starts) for c in (1, 0))
        wins = pos @ (np.cumsum(neg) - neg / 2)
        miss = np.where(none, 0.0, pos * (1 - u) ** 2 + neg * u**2).sum()
        sums = (x.sum() for x in (pos[over], neg[over]))
        out.append((rate, pos.sum(), neg.sum(), wins, *sums, miss, (pos + neg)[none].sum()))
    out = pd.DataFrame(out, columns=["rate", "pos", "neg", "_wins", "tp", "fp", "_sse", "n_unscored"])
    for j, c in enumerate(("variant", "view", "part")):
        out.insert(j, c, part[c].iloc[0])
    return out


def cross_dataset(df: DataFrame, spec: ViewSpec, grid: list[dict[str, float]]) -> DataFrame:
    """Fit everything on one dataset, score the test rows of every other one.

    ``df`` has dataset, split, y, i, t and the features. The datasets are those with
    train rows. The fitted tables have one row per dataset and are staged: each is
    computed once.
    """
    keys = ["fit_dataset"]
    fit = fit_view_params(df.where(F.col("split") == "train"), spec, by=["dataset"])
    fitted = stage(score_constants(fit, spec, ["dataset"]), "cross_constants").withColumnRenamed("dataset", keys[0])
    val = df.where(F.col("split") == "validation").withColumn("fit_dataset", F.col("dataset"))
    names = fitted.where(F.col(keys[0]).isNotNull()).agg(F.array_sort(F.collect_set(keys[0])).alias("names"))
    test = with_scalar(df.where(F.col("split") == "test"), names, "_D")
    test = test.withColumn("fit_dataset", F.explode(F.array_except("_D.names", F.array("dataset")))).drop("_D")
    test = test.withColumnRenamed("dataset", "test_dataset")
    compared = {"reliability": F.col("s")}
    return _fitted_chain(val, test, fitted, spec, keys, grid, compared, ["test_dataset"]).drop("variant")


def _fitted_chain(val, test, constants, spec, keys, grid, compared, more=()) -> DataFrame:
    """Metrics of the ``compared`` scores on test rows, by ``keys`` and ``more``, with weights,
    coefficients and thresholds that were fitted on the validation rows of the same keys."""
    names = [c for c in constants.columns if c not in keys]
    packed = constants.select(*keys, F.struct(*names).alias("_P"))

    def scored(rows: DataFrame) -> DataFrame:
        rows = with_scores(with_fitted(rows, packed, keys, ["_P"]), spec)
        rows = rows.withColumn("b_gaussian", gaussian_baseline(spec))
        if "b" in names:
            rows = rows.withColumn("b_logistic", logistic.probability(spec.features, "_P"))
        return with_quality(rows.drop("_P"), spec)

    # Validation rows are scored once; three fits read the scores.
    ready = scored(val)
    used = ["y", "i", "t", *keys, *[c for v in spec.names for c in (f"p_{v}", f"q_{v}")]]
    used += [c for c in ready.columns if c in ("b_gaussian", "b_logistic")]
    ready = stage(ready.select(*used), "scored_validation")
    g = [f"g_{v}" for v in spec.names]
    weights = stage(fit_view_weights(ready, spec, by=keys), "fitted_weights")
    weighed = lambda rows: with_fitted(rows, weights, keys, g)
    alpha = stage(fit_alpha(weighed(ready).withColumn("_G", F.struct(*g)), spec, grid, by=keys), "fitted_alpha")
    a = ["a_i", "a_q", "a_t"]
    fused_ = lambda rows: fuse(with_fitted(weighed(rows), alpha, keys, a), spec, weight_columns(spec), tuple(F.col(n) for n in a))
    columns = {n: f"_s_{k}" for k, n in enumerate(compared)}
    final = lambda rows: fused_(rows).withColumns({c: compared[n] for n, c in columns.items()})
    theta = stage(thresholds(ready, final, keys, columns), "fitted_theta")
    return measures(test, lambda rows: final(scored(rows)), [*keys, *more], columns, theta)


def cv_scores(
    df: DataFrame,
    folds: DataFrame,
    spec: ViewSpec,
    k: int,
    grid: list[dict[str, float]],
    key: str = "record_id",
) -> DataFrame:
    """Metrics of every variant, repeat and fold.

    Model f is tested on fold f, takes weights, coefficients and thresholds from
    the next fold and is trained on the rest, so no number it uses has seen its test rows. Per
    fold class statistics are computed once and merged into the k models; rows
    are never copied per model. A record is stored once with its fold of every
    repeat and is spread over the repeats while it is read. Fitted tables have
    repeats * k rows and are attached as one map each.
    """
    assigned = folds.groupBy(key).agg(F.collect_list(F.struct("repeat", "fold")).alias("_in"))
    records = stage(df.join(assigned, key), "cv_records")
    rows = records.select(*[c for c in df.columns], F.inline("_in"))
    fold = F.col("fold")
    trains = F.filter(
        F.sequence(F.lit(0), F.lit(k - 1)), lambda f: (f != fold) & (F.pmod(f + 1, F.lit(k)) != fold)
    )
    per_fold = fit_view_params(rows, spec, by=["repeat", "fold"])
    models = merge_fold_params(per_fold, spec, ["repeat"], "fold", trains, "model_fold")
    keys = ["repeat", "model_fold"]
    models = stage(models, "cv_models")
    spread = rows.select("repeat", F.explode(trains).alias("model_fold"), "y", *spec.features)
    fitted = logistic.fit_logistic(spread, models, spec.features, keys)
    constants = stage(score_constants(models, spec, keys).join(fitted, keys), "cv_constants")
    cast = lambda model: rows.withColumn("model_fold", model.cast("int"))
    compared = {
        **standard_variants(spec),
        "baseline:gaussian": F.col("b_gaussian"),
        "baseline:logistic": F.col("b_logistic"),
    }
    val = cast(F.pmod(fold + F.lit(k - 1), F.lit(k)))
    per_model = _fitted_chain(val, cast(fold), constants, spec, keys, grid, compared)
    named = F.array(
        *[
            F.struct(F.lit(m).alias("metric"), F.col(m).alias("value"))
            for m in ("accuracy", "auc", "brier", "f1")
        ]
    )
    return per_model.select(
        F.col("variant").alias("model"), "repeat", F.col("model_fold").alias("fold"), F.inline(named)
    )
