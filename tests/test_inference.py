import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.operators import inference

SCORES = "metric string, model string, repeat int, fold int, value double"

# Points of the chi-square distribution with their tail shares.
POINTS = [(3.841458820694124, 1, 0.05), (5.991464547107979, 2, 0.05), (7.814727903251179, 3, 0.05), (18.307038053275146, 10, 0.05), (6.634896601021213, 1, 0.01), (124.342113, 100, 0.05)]


def test_chi_square_tail(spark):
    df = spark.createDataFrame([(x, d, p) for x, d, p in POINTS] + [(0.0, 4, 1.0), (900.0, 3, 0.0)], "x double, d long, p double")
    for r in df.withColumn("got", inference.chi_square_p(F.col("x"), F.col("d"))).collect():
        assert r["got"] == pytest.approx(r["p"], abs=1e-8)
    assert spark.range(1).select(inference.chi_square_p(F.lit(1.0), F.lit(0))).first()[0] is None


def ranks(values):
    return [sum(u > v for u in values) + (sum(u == v for u in values) + 1) / 2 for v in values]


def test_friedman_by_hand(spark):
    rng = random.Random(2)
    rows, blocks = [], []
    for i in range(12):
        values = [round(rng.random() + 0.2 * j, 1) for j in range(4)]
        blocks.append(values)
        rows += [("m", f"x{j}", i // 3, i % 3, v) for j, v in enumerate(values)]
    rows += [("m", "x0", 9, 0, 1.0), ("m", "x1", 9, 0, None)]  # incomplete
    rows += [("tied", f"x{j}", i, 0, 0.5) for i in range(3) for j in range(3)] + [("alone", "x0", 0, 0, 1.0)]
    got = {(r["metric"], r["model"]): r for r in inference.friedman(spark.createDataFrame(rows, SCORES), ["metric"]).collect()}
    r = np.array([ranks(b) for b in blocks])
    n, k = r.shape
    chi = (k - 1) * ((r.sum(axis=0) - n * (k + 1) / 2) ** 2).sum() / ((r**2).sum() - n * k * (k + 1) ** 2 / 4)
    for j in range(4):
        row = got["m", f"x{j}"]
        assert (row["n"], row["models"]) == (12, 4) and row["mean_rank"] == pytest.approx(r[:, j].mean())
        assert row["chi_square"] == pytest.approx(chi) and 0 < row["p"] < 1
    assert got["tied", "x0"]["mean_rank"] == 2 and got["tied", "x0"]["chi_square"] is None
    assert got["alone", "x0"]["p"] is None
    assert inference.friedman(spark.createDataFrame([], SCORES), ["metric"]).count() == 0


def test_holm_by_hand(spark):
    rows = [("a", "t1", 0.01), ("a", "t2", 0.04), ("a", "t3", 0.03), ("a", "t4", None), ("b", "t1", 0.6), ("b", "t2", 0.6)]
    out = inference.holm(spark.createDataFrame(rows, "g string, name string, p double"), ["g"], "name")
    got = {(r["g"], r["name"]): r["p_holm"] for r in out.collect()}
    assert got["a", "t1"] == pytest.approx(0.03) and got["a", "t3"] == got["a", "t2"] == pytest.approx(0.06)
    assert got["a", "t4"] is None and got["b", "t1"] == got["b", "t2"] == 1.0


def test_poisson_counts(spark):
    counts = spark.range(40000).select(inference.poisson_count(7, "id").alias("w")).groupBy("w").count().collect()
    share = {r["w"]: r["count"] / 40000 for r in counts}
    for k in range(4):
        assert share[k] == pytest.approx(math.exp(-1) / math.factorial(k), abs=0.01)


def test_bootstrap_keeps_entities_together(spark):
    """Records of an entity repeat its value: the error is that of the entities' mean, not of the records'."""
    rng = random.Random(8)
    rows = [(g, e, v) for g in "pq" for e in range(3000) for v in [rng.gauss(1, 2)] for _ in range(5)] + [("p", 5, None)]
    df = spark.createDataFrame(rows, "g string, e long, v double").repartition(7)
    got = {r["g"]: r for r in inference.bootstrap_means(df, ["g"], "v", "e").collect()}
    for g in "pq":
        values = [v for h, _, v in rows if h == g and v is not None]
        r = got[g]
        assert r["n"] == len(values) == 15000 and r["mean"] == pytest.approx(np.mean(values))
        assert r["se"] == pytest.approx(2 / math.sqrt(3000), rel=0.2)
        assert r["low"] < r["mean"] < r["high"] and r["high"] - r["low"] == pytest.approx(2 * 1.96 * r["se"], rel=0.2)
    again = inference.bootstrap_means(df.repartition(3), ["g"], "v", "e").collect()
    assert {r["g"]: round(r["low"], 9) for r in again} == {g: round(r["low"], 9) for g, r in got.items()}
    assert inference.bootstrap_means(df.limit(0), ["g"], "v", "e").count() == 0
