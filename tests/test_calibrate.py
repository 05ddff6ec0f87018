import random

import pytest
from pyspark.sql import functions as F

from plumbline.operators import calibrate

SCHEMA = "id long, c double, h int"


def least_squares(counts):
    """Isotonic means by their max-min formula."""
    keys = sorted(counts)

    def mean(i, j):
        part = [counts[k] for k in keys[i : j + 1]]
        return sum(h for _, h in part) / sum(n for n, _ in part)

    return {
        k: max(min(mean(i, j) for j in range(at, len(keys))) for i in range(at + 1)) for at, k in enumerate(keys)
    }


@pytest.mark.parametrize("seed,width", [(1, 7), (2, 64), (3, 4096)])
def test_against_the_formula(spark, seed, width):
    """The same fit whatever the ranges that are pooled first."""
    rng = random.Random(seed)
    cells = 64
    rows = [(i, c, int(rng.random() < c * c)) for i in range(700) for c in [rng.random()]]
    rows += [(1000, None, 1), (1001, 0.5, None), (1002, 1.0, 1), (1003, 0.0, 0)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(6)
    fitted = calibrate.fit_isotonic(df, "c", "h", cells, width)
    counts = {}
    for _, c, h in rows:
        if c is not None and h is not None:
            n, hits = counts.get(int(c * cells), (0, 0))
            counts[int(c * cells)] = (n + 1, hits + h)
    want = least_squares(counts)
    got = {r["id"]: r["calibrated"] for r in calibrate.calibrate(df, "c", fitted, cells=cells).collect()}
    for i, c, _ in rows:
        assert got[i] == (None if c is None else pytest.approx(want[int(c * cells)], abs=1e-12))


def test_gaps_take_the_block_below(spark):
    df = spark.createDataFrame([(1, 0.25, 0), (2, 0.5, 1), (3, 0.5, 0), (4, 0.75, 1)], SCHEMA)
    fitted = calibrate.fit_isotonic(df, "c", "h", 8, 2)
    values = fitted.first()["values"]
    assert values == [0.0] * 4 + [0.5] * 2 + [1.0] * 3
    none = calibrate.fit_isotonic(df.where("id > 9"), "c", "h", 8, 2)
    assert calibrate.calibrate(df, "c", none, cells=8).where("calibrated is null").count() == 4


def test_error_falls_on_other_rows(spark):
    rng = random.Random(5)
    rows = [(i, c, int(rng.random() < c**3)) for i in range(8000) for c in [rng.random()]]
    df = spark.createDataFrame(rows, SCHEMA)
    fitted = calibrate.fit_isotonic(df.where("id % 2 = 0"), "c", "h")
    out = calibrate.calibrate(df.where("id % 2 = 1"), "c", fitted)
    error = {r["measure"]: r for r in calibrate.calibration_error(out, ["c", "calibrated"], "h").collect()}
    assert error["calibrated"]["expected_error"] < 0.3 * error["c"]["expected_error"]
    assert error["calibrated"]["brier"] < error["c"]["brier"] and error["c"]["n"] == 4000


def test_one_confidence_on_a_third_of_all_rows(spark):
    df = spark.range(30000).select(
        "id", F.when(F.col("id") % 3 == 0, 0.6).otherwise(F.rand(7)).alias("c"), (F.col("id") % 5 == 0).cast("int").alias("h")
    )
    values = calibrate.fit_isotonic(df, "c", "h").first()["values"]
    assert len(values) == calibrate.CELLS + 1 and values == sorted(values)
