import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.operators import auctest

SCHEMA = "id long, g string, y int, a double, b double"


def parts(y, s):
    s = np.array([-1.0 if v is None else v for v in s])
    pos, neg = s[y == 1][:, None], s[y == 0][None, :]
    won = (pos > neg) + 0.5 * (pos == neg)
    return won.mean(axis=1), won.mean(axis=0)


def made(seed, n=400):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        y = int(rng.random() < 0.4)
        # Few distinct values: many ties; some records have no score.
        a, b = (min(max(round(rng.gauss(0.4 + 0.2 * y * k, 0.2), 1), 0.0), 1.0) for k in (1, 0.5))
        rows.append((i, "even" if i % 2 else None, None if i % 41 == 0 else y, None if i % 29 == 0 else a, None if i % 31 == 0 else b))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_interval_against_all_pairs(spark, seed):
    rows = made(seed)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = {r["g"]: r for r in auctest.auc_interval(df, ["g"], "a").collect()}
    for g in (None, "even"):
        mine = [r for r in rows if r[1] == g and r[2] is not None]
        y = np.array([r[2] for r in mine])
        up, down = parts(y, [r[3] for r in mine])
        se = math.sqrt(up.var(ddof=1) / len(up) + down.var(ddof=1) / len(down))
        assert got[g]["auc"] == pytest.approx(up.mean()) and got[g]["se"] == pytest.approx(se)
        assert got[g]["low"] == pytest.approx(max(0, up.mean() - auctest.Z95 * se))


def test_difference_against_covariances(spark):
    rows = made(3)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    scores = {"base": F.col("a"), "other": F.col("b"), "same": F.col("a")}
    got = {r["versus"]: r for r in auctest.auc_differences(df, scores, "base").collect()}
    mine = [r for r in rows if r[2] is not None]
    y = np.array([r[2] for r in mine])
    a, b = parts(y, [r[3] for r in mine]), parts(y, [r[4] for r in mine])
    var = 0.0
    for u, v in zip(a, b):
        cov = np.cov(u, v)
        var += (cov[0, 0] + cov[1, 1] - 2 * cov[0, 1]) / len(u)
    out = got["other"]
    assert out["difference"] == pytest.approx(a[0].mean() - b[0].mean())
    assert out["se"] == pytest.approx(math.sqrt(var)) and out["z"] == pytest.approx(out["difference"] / math.sqrt(var))
    assert got["same"]["difference"] == 0 and got["same"]["z"] is None


def test_one_class_and_no_rows(spark):
    one = spark.createDataFrame([(1, "x", 1, 0.5, 0.5), (2, "x", 1, 0.7, 0.5)], SCHEMA)
    row = auctest.auc_interval(one, ["g"], "a").first()
    assert (row["auc"], row["se"], row["n_neg"]) == (None, None, 0)
    assert auctest.auc_interval(one.where("id > 5"), ["g"], "a").count() == 0
    assert auctest.auc_differences(one.where("id > 5"), {"p": F.col("a"), "q": F.col("b")}, "p").count() == 0


def test_interval_covers_the_true_area(spark):
    """200 draws of 100 records: the interval holds the true area in about 95 % of them."""
    rng = random.Random(11)
    rows = []
    for g in range(200):
        for i in range(100):
            z = rng.gauss(1.0 if i % 2 else 0.0, 1)
            rows.append((i, str(g), i % 2, 1 / (1 + math.exp(-z)), None))
    df = spark.createDataFrame(rows, SCHEMA)
    true = 0.5 * (1 + math.erf(0.5))
    held = auctest.auc_interval(df, ["g"], "a").where((F.col("low") <= true) & (F.col("high") >= true)).count()
    assert 178 <= held <= 200
