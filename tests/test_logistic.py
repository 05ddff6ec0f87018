import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.operators import logistic
from plumbline.operators.scoring import fit_view_params
from plumbline.spec import ViewSpec

SPEC = ViewSpec({"all": ("u", "v", "w")})
SCHEMA = "id long, model int, y int, u double, v double, w double"


def made(seed, n=900, models=2):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        u, v, w = rng.gauss(5, 2), rng.gauss(0, 1), 3.0
        y = int(rng.random() < 1 / (1 + math.exp(-(0.6 * (u - 5) - 1.2 * v + 0.3))))
        rows.append((i, i % models, y, None if i % 17 == 0 else u, float("nan") if i % 23 == 0 else v, w))
    return rows


def expected(rows):
    """Newton's method to convergence in numpy."""
    x = np.array([[np.nan if a is None else a for a in r[3:]] for r in rows])
    mean, sd = np.nanmean(x, axis=0), np.nanstd(x, axis=0, ddof=1)
    sd[~(sd**2 > 1e-12)] = 1.0
    z = np.hstack([np.ones((len(x), 1)), np.nan_to_num((x - mean) / sd)])
    y, b = np.array([r[2] for r in rows]), np.zeros(4)
    penalty = np.diag([0.0] + [logistic.RIDGE * len(x)] * 3)
    for _ in range(50):
        p = 1 / (1 + np.exp(-z @ b))
        b = b + np.linalg.solve((z.T * (p * (1 - p))) @ z + penalty, z.T @ (y - p) - penalty @ b)
    return b


def fitted(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    df = df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in "uvw"})
    params = fit_view_params(df, SPEC, by=["model"])
    return df, logistic.fit_logistic(df, params, SPEC.features, ["model"])


def test_every_model_against_numpy(spark):
    rows = made(1)
    _, models = fitted(spark, rows)
    got = {r["model"]: r["b"] for r in models.collect()}
    assert sorted(got) == [0, 1]
    for m, b in got.items():
        assert np.allclose(b, expected([r for r in rows if r[1] == m]), atol=1e-6)


def test_probabilities_follow_the_model(spark):
    rows = made(2, models=1)
    df, models = fitted(spark, rows)
    one = models.drop("model").select(F.struct("*")).scalar()
    scored = df.withColumn("_L", one).select("y", "u", "v", logistic.probability(["u", "v"], "_L").alias("s")).collect()
    hits = sum((r["s"] >= 0.5) == bool(r["y"]) for r in scored if r["s"] is not None)
    assert hits > 0.7 * len(scored)
    assert all((r["s"] is None) == (r["u"] is None and r["v"] is None) for r in scored)


def test_one_class_and_no_rows(spark):
    rows = [(i, 0, 1, float(i), 0.0, 0.0) for i in range(5)]
    _, models = fitted(spark, rows)
    assert models.collect()[0]["b"] == [0.0] * 4
    _, models = fitted(spark, [])
    assert models.collect() == []


def test_separable_classes_stay_finite(spark):
    rows = [(i, 0, int(i >= 20), float(i), 0.0, 1.0) for i in range(40)]
    _, models = fitted(spark, rows)
    b = models.collect()[0]["b"]
    assert all(map(math.isfinite, b)) and b[1] > 1


@pytest.mark.parametrize("keys", [[], ["model"]])
def test_names_of_models(spark, keys):
    rows = made(3, n=60, models=1)
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in "uvw"})
    models = logistic.fit_logistic(df, fit_view_params(df, SPEC, by=keys), SPEC.features, keys)
    assert models.columns == [*keys, "mu", "sd", "b"] and models.count() == 1
