"""Held-out rows must not reach any fitted table."""

from pyspark.sql import functions as F

from plumbline.operators import evaluate, fusion, prepare, scoring
from plumbline.operators.reliability import ALPHA, simplex_grid
from plumbline.operators.reasoning import confidence_parts, fit_beta, reason
from plumbline.operators.views import with_quality
from plumbline.plans.bindings import EVENT_VIEWS as SPEC
from plumbline.plans.bindings import event_evidence_plan
from plumbline.functions.scalars import with_scalar

SF_DIR = "/root/testdata/sf0.001"


def fitted(rows):
    part = lambda s: rows.where(F.col("split") == s)
    params = scoring.fit_view_params(part("train"), SPEC)
    scaler = prepare.fit_scaler(part("train"), SPEC.features)
    val = scoring.score_views(part("validation"), SPEC, params)
    weights = fusion.fit_view_weights(val, SPEC)
    val = with_scalar(val, weights, "_G")
    g = fusion.weight_columns(SPEC, "_G")
    alpha = fusion.fit_alpha(val, SPEC, simplex_grid(("a_i", "a_q", "a_t"), 3))
    val = fusion.fuse(val, SPEC, g, ALPHA)
    theta = evaluate.fit_threshold(val)
    best = theta.first()
    cases = reason(val, SPEC, F.lit(best.theta))
    cases = confidence_parts(cases, SPEC, g, F.lit(best.theta))
    beta = fit_beta(cases, simplex_grid(("b_r", "b_a", "b_m"), 3))
    return [t.first().asDict() for t in (params, scaler, weights, alpha, theta, beta)]


def test_test_rows_change_nothing(spark):
    rows = event_evidence_plan(spark, SF_DIR)
    test = F.col("split") == "test"
    changed = rows.withColumns(
        {
            "y": F.when(test, 1 - F.col("y")).otherwise(F.col("y")),
            "value": F.when(test, F.lit(1e9)).otherwise(F.col("value")),
        }
    )
    changed = with_quality(changed, SPEC)
    assert fitted(rows) == fitted(changed)


def test_split_is_a_function_of_the_key(spark):
    rows = event_evidence_plan(spark, SF_DIR).select("record_id", "split")
    again = rows.repartition(5).orderBy("record_id")
    assert rows.orderBy("record_id").collect() == again.collect()
