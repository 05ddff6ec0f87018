"""Planted records with a hand-computed answer, and invariants of the fusion."""

import math

import pytest
from pyspark.sql import functions as F

from plumbline.functions.scalars import finite, with_scalar
from plumbline.operators import fusion, reasoning, scoring
from plumbline.operators.experiments import ablation_scores, degrade
from plumbline.operators.integrity import integrity_factor
from plumbline.operators.reliability import ALPHA, reliability, select_params, simplex_grid
from plumbline.operators.temporal import temporal_factor
from plumbline.operators.views import finite_features, melt_views, to_views, with_quality
from plumbline.spec import ViewSpec

SPEC = ViewSpec({"a": ("x1", "x2"), "b": ("x3",)})
SCHEMA = "record_id string, y int, x1 double, x2 double, x3 double, i double, t double"


def records(spark, rows):
    return finite_features(spark.createDataFrame(rows, SCHEMA), SPEC)


def test_nan_and_infinity_are_missing(spark):
    df = spark.createDataFrame([(float("nan"),), (float("inf"),), (float("-inf"),), (1.5,), (None,)], "x double")
    assert [r[0] for r in df.select(finite("x")).collect()] == [None, None, None, 1.5, None]


def train(spark):
    rows = [
        (f"t{j}", j % 2, float(j % 2) + 0.1 * (j // 2), 2.0 - (j % 2) + 0.2 * (j // 2), 5.0 * (j % 2) + (j // 2), 1.0, 1.0)
        for j in range(8)
    ]
    return records(spark, rows)


def gaussian(x, xs):
    m = sum(xs) / len(xs)
    v = sum((a - m) ** 2 for a in xs) / (len(xs) - 1)
    return -0.5 * math.log(v) - (x - m) ** 2 / (2 * v)


def test_view_score_is_the_class_posterior(spark):
    t = train(spark)
    got = scoring.score_views(
        records(spark, [("r", None, 0.4, 1.1, None, 1.0, 1.0)]), SPEC, scoring.fit_view_params(t, SPEC)
    ).first()
    rows = t.collect()
    logit = 0.0
    for f, x in (("x1", 0.4), ("x2", 1.1)):
        one, zero = ([r[f] for r in rows if r.y == c] for c in (1, 0))
        logit += gaussian(x, one) - gaussian(x, zero)
    assert got.p_a == pytest.approx(1 / (1 + math.exp(-logit)), abs=1e-12)
    assert got.p_b is None


def test_saved_parameters_round_trip(spark):
    params = scoring.fit_view_params(train(spark), SPEC)
    again = scoring.params_wide(scoring.params_long(params, SPEC), SPEC)
    assert params.first().asDict() == again.first().asDict()


def test_merged_fold_parameters_equal_a_direct_fit(spark):
    t = train(spark).unionByName(train(spark).withColumn("x1", F.col("x1") + 1e6))
    t = t.withColumn("fold", F.pmod(F.xxhash64("record_id", "x1"), F.lit(4)).cast("int")).withColumn("repeat", F.lit(1))
    stats = scoring.fit_view_params(t, SPEC, by=["repeat", "fold"])
    trains = F.filter(F.sequence(F.lit(0), F.lit(3)), lambda f: f != F.col("fold"))
    merged = scoring.merge_fold_params(stats, SPEC, ["repeat"], "fold", trains, "model")
    for row in merged.collect():
        direct = scoring.fit_view_params(t.where(F.col("fold") != row.model), SPEC).first()
        for name, value in direct.asDict().items():
            assert row[name] == pytest.approx(value, rel=1e-9), name


def scored(spark, rows):
    return spark.createDataFrame(
        rows, "record_id string, y int, i double, t double, q_a double, q_b double, p_a double, p_b double"
    )


def weights():
    return {"a": F.lit(0.6), "b": F.lit(0.2)}


def test_equal_weights_reduce_to_the_plain_mean(spark):
    df = scored(spark, [("r", 1, 0.5, 0.5, 0.5, 0.5, 0.9, 0.2)])
    same = {"a": F.lit(0.3), "b": F.lit(0.3)}
    row = fusion.fuse(df, SPEC, same, ALPHA).withColumn("u", fusion.unweighted(SPEC)).first()
    assert row.s == pytest.approx(row.u) == pytest.approx(0.55)


def test_missing_view_is_left_out(spark):
    df = scored(spark, [("one", 1, 1.0, 1.0, 1.0, 0.0, 0.9, None), ("none", 1, 1.0, 1.0, 0.0, 0.0, None, None)])
    got = {r.record_id: r.s for r in fusion.fuse(df, SPEC, weights(), ALPHA).collect()}
    assert got["one"] == pytest.approx(0.9) and got["none"] is None


def test_fused_by_hand(spark):
    df = scored(spark, [("r", 1, 1.0, 0.5, 1.0, 0.5, 0.9, 0.2)]).withColumns(
        reliability(SPEC, (0.4, 0.3, 0.3))
    )
    row = fusion.fuse(df, SPEC, weights(), ALPHA).first()
    r_a, r_b = 0.4 + 0.3 + 0.15, 0.4 + 0.15 + 0.15
    assert (row.r_a, row.r_b) == (pytest.approx(r_a), pytest.approx(r_b))
    w_a, w_b = 0.6 * r_a, 0.2 * r_b
    assert row.s == pytest.approx((w_a * 0.9 + w_b * 0.2) / (w_a + w_b))


def test_factors(spark):
    df = spark.createDataFrame(
        [("verified", 1, None, True), ("mismatch", 1, 86400.0, True), ("unlisted", None, 5.0, True), (None, 1, 0.0, False)],
        "status string, ts_us long, gap double, ok boolean",
    )
    rows = df.select(integrity_factor().alias("i"), temporal_factor(in_order=F.col("ok")).alias("t")).collect()
    assert [(r.i, r.t) for r in rows] == [(1.0, 0.5), (0.0, 0.5), (0.5, 0.0), (0.5, 0.0)]


def test_quality_and_long_views(spark):
    df = records(spark, [("r", 1, 1.0, float("nan"), None, 1.0, 1.0)])
    row = with_quality(df, SPEC).first()
    assert (row.q_a, row.q_b) == (0.5, 0.0)
    long = {(r.view, r.feature): r.x for r in to_views(df, SPEC, ["record_id"]).collect()}
    assert long == {("a", "x1"): 1.0, ("a", "x2"): None, ("b", "x3"): None}


def reasoned(spark, rows, theta=0.5):
    g = {v: F.lit(0.5) for v in SPEC.names}
    df = fusion.fuse(scored(spark, rows), SPEC, g, ALPHA)
    out = reasoning.reason(df, SPEC, F.lit(theta))
    return reasoning.confidence_parts(out, SPEC, g, F.lit(theta))


def test_verdicts(spark):
    rows = [
        ("altered file", 1, 0.0, 1.0, 1.0, 1.0, 0.9, 0.9),
        ("no view", 1, 1.0, 1.0, 0.0, 0.0, None, None),
        ("torn", 1, 1.0, 1.0, 1.0, 1.0, 0.9, 0.1),
        ("bad", 1, 1.0, 1.0, 1.0, 1.0, 0.9, 0.8),
        ("good", 0, 1.0, 1.0, 1.0, 1.0, 0.1, 0.2),
    ]
    got = {r.record_id: r for r in reasoned(spark, rows).collect()}
    assert {k: r.verdict for k, r in got.items()} == {
        "altered file": "insufficient", "no view": "insufficient", "torn": "contested", "bad": "attack", "good": "benign",
    }
    assert got["torn"].supporting == ["a"] and got["torn"].contradicting == ["b"]
    assert [c.view for c in got["bad"].contributions] == ["a", "b"]
    for r in got.values():
        if r.s is not None:
            assert sum(c.share for c in r.contributions) == pytest.approx(1.0)
            assert all(0 <= x <= 1 for x in (r.s, r.c_r, r.c_a, r.c_m))
    assert got["good"].c_a == pytest.approx(1 - 2 * 0.05)
    assert got["good"].c_m == pytest.approx(0.7)


def test_grid_selection_prefers_the_best_and_earliest(spark):
    grid = simplex_grid(("a", "b"), 4)
    assert len(grid) == 5 and all(sum(p.values()) == pytest.approx(1) for p in grid)
    df = spark.createDataFrame([(0.25,), (0.25,)], "target double")
    loss = lambda rows: rows.withColumn("_loss", F.abs(F.col("_cand.a") - F.col("target")))
    assert select_params(df, grid, loss).first().a == 0.25
    flat = select_params(df, grid, lambda rows: rows.withColumn("_loss", F.lit(1.0))).first()
    assert flat.grid_id == 0


@pytest.mark.parametrize("mode", ["drop", "noise"])
def test_degradation_at_rate_zero_and_one(spark, mode):
    df = train(spark)
    scale = {f: F.lit(1.0) for f in SPEC.features}
    at = lambda rate: {
        r.record_id: (r.x1, r.x2, r.x3)
        for r in degrade(df, SPEC, F.lit("a"), F.lit(rate), 1, mode=mode, scale=scale).collect()
    }
    clean = {r.record_id: (r.x1, r.x2, r.x3) for r in df.collect()}
    assert at(0.0) == clean
    gone = at(1.0)
    assert all(gone[k][2] == clean[k][2] for k in clean)
    if mode == "drop":
        assert all(v[:2] == (None, None) for v in gone.values())
    else:
        assert all(gone[k][0] != clean[k][0] and abs(gone[k][0] - clean[k][0]) <= 1 for k in clean)


def test_ablation_full_and_unweighted_match_the_fusions(spark):
    df = scored(spark, [("r", 1, 1.0, 0.5, 1.0, 0.5, 0.9, 0.2)])
    alpha = tuple(F.lit(a) for a in (0.4, 0.3, 0.3))
    got = {r.variant: r.s for r in ablation_scores(df, SPEC, weights(), alpha, ["record_id"]).collect()}
    assert got["full"] == pytest.approx(fusion.fuse(df, SPEC, weights(), ALPHA).first().s)
    assert got["unweighted"] == pytest.approx(0.55)
    assert got["without:b"] == pytest.approx(0.9)


def test_melt_keeps_every_view(spark):
    df = scored(spark, [("r", 1, 1.0, 1.0, 1.0, 0.0, 0.9, None)])
    rows = melt_views(df, SPEC, ["record_id"], p="p_", q="q_").collect()
    assert {(r.view, r.p, r.q) for r in rows} == {("a", 0.9, 1.0), ("b", None, 0.0)}


def test_scalar_table_must_be_one_row(spark):
    df = spark.range(3)
    two = spark.range(2).select(F.col("id").alias("v"))
    with pytest.raises(Exception):
        with_scalar(df, two, "v").collect()
