"""Thresholds and metrics of many scores of a row, against those of a row per score."""

import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from plumbline.functions.scalars import with_fitted
from plumbline.operators import evaluate as E
from plumbline.operators import experiments as X
from plumbline.operators import fusion
from plumbline.operators import scoreranges as R
from plumbline.operators.reliability import select_params, simplex_grid
from plumbline.session import stage
from plumbline.spec import ViewSpec

SPEC = ViewSpec({"a": ("x",), "b": ("z",)})


@pytest.fixture
def rows(spark):
    """Ties, missing scores, NaN, unknown and other classes, a null key, a group of one class, one without a score."""
    rng = np.random.default_rng(7)
    n = 600
    pdf = pd.DataFrame({"g": rng.choice(["a", "b", "one", "bare", ""], n), "y": rng.choice([0, 1, 2, 9], n, p=[0.55, 0.35, 0.05, 0.05]), "s": rng.random(n).round(3), "r": rng.integers(0, 6, n) / 5})
    df = spark.createDataFrame(pdf)
    none = (F.col("g") == "bare") | (F.col("s") < 0.05)
    return df.select(
        F.nullif("g", F.lit("")).alias("g"), F.when(F.col("y") < 9, F.when(F.col("g") == "one", 0).otherwise(F.col("y"))).alias("y"),
        F.when(~none, F.when(F.col("s") > 0.97, float("nan")).otherwise(F.col("s"))).alias("s"), "r",
    )


@pytest.mark.parametrize("keys, size", [([], 25), (["g"], 1 << 19), (["g"], 25)])
def test_ranges_give_what_a_row_per_score_gives(spark, rows, monkeypatch, keys, size):
    monkeypatch.setattr(R, "RANGE", size)
    monkeypatch.setattr(R, "CHUNK", 100)
    scores = {"first": "s", "second": "r"}
    long = X.score_variants(rows, {n: F.col(c) for n, c in scores.items()}, ["g", "y"])
    by = [*keys, "variant"]
    want = E.fit_threshold(long, by)
    theta = R.thresholds(rows, lambda r: r, keys, scores)
    table = lambda df: sorted(map(str, df.select(*by, "theta", F.round("youden", 9)).collect()))
    assert table(theta) == table(want)
    fitted = stage(want.withColumn("theta", F.when(F.col("variant") == "first", F.col("theta"))), "some_thetas")
    got = R.measures(rows, lambda r: r, keys, scores, fitted)
    want = E.metrics(with_fitted(long, fitted, by, ["theta"]), [*by, "theta"])
    assert got.columns == want.columns
    frame = lambda df: df.withColumn("nan", F.isnan("brier")).toPandas().fillna({"g": "-"} if keys else {}).sort_values(by).reset_index(drop=True)
    pd.testing.assert_frame_equal(frame(got), frame(want), check_exact=False, rtol=1e-12)


def test_no_row_per_score_is_shuffled(spark, rows):
    scores = {"first": "s", "second": "r"}
    theta = R.thresholds(rows, lambda r: r, ["g"], scores)
    for out in (theta, R.measures(rows, lambda r: r, ["g"], scores, theta)):
        keys = re.findall(r"Exchange hashpartitioning\(([^)]*)", out._jdf.queryExecution().executedPlan().toString())
        assert keys and all("_group" in k or "_nth" in k for k in keys)
    many = spark.range(20_000).selectExpr("cast(id % 2 AS int) AS y", "id / 20000 AS s", "1 - id / 20000 AS r")
    packed = R.packed(R._Groups(many, [], "y"), lambda r: r, ["s", "r"], "y")
    assert packed.count() <= 2 * many.rdd.getNumPartitions()


def test_no_rows_give_no_metrics(spark, rows):
    none = rows.where("y > 7")
    theta = R.thresholds(none, lambda r: r, ["g"], {"first": "s"})
    assert theta.count() == 0 and R.measures(none, lambda r: r, [], {"first": "s"}, theta.drop("g")).count() == 0


def test_coefficients_follow_from_sums_of_a_row(spark):
    """As by a row per candidate, which no longer exists in the plan."""
    df = spark.range(200).selectExpr(
        "id % 3 AS g", "cast(id % 2 AS int) AS y", "if(id % 7 = 0, null, (id * 37 % 100) / 100) AS p_a", "if(id % 5 = 0, null, (id * 53 % 100) / 100) AS p_b",
        "cast(id % 4 AS double) / 3 AS i", "if(id % 11 = 0, 0.0, 0.7) AS q_a", "0.4 AS q_b", "(id % 10) / 10 AS t", "named_struct('g_a', 0.3D, 'g_b', 0.6D) AS _G",
    ).selectExpr("g", "y", "_G", *[f"cast({c} AS double) AS {c}" for c in ("p_a", "p_b", "i", "q_a", "q_b", "t")])
    grid = simplex_grid(("a_i", "a_q", "a_t"))

    def with_loss(rows):
        rows = fusion.fuse(rows, SPEC, fusion.weight_columns(SPEC, "_G"), fusion.alpha_columns("_cand"))
        return rows.withColumn("_loss", (F.col("s") - F.col("y")) * (F.col("s") - F.col("y")))

    for by in ([], ["g"]):
        got, want = fusion.fit_alpha(df, SPEC, grid, by=by), select_params(df, grid, with_loss, by)
        assert got.columns == want.columns
        frame = lambda out: out.toPandas().sort_values(out.columns).reset_index(drop=True)
        pd.testing.assert_frame_equal(frame(got), frame(want), check_exact=False, rtol=1e-12)
        assert "Generate" not in got._jdf.queryExecution().optimizedPlan().toString().split("Aggregate")[-1]
    assert fusion.fit_alpha(df.limit(0), SPEC, grid).first().a_i is None
