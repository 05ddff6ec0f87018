"""Operators that cut a hot group, against a direct computation in pandas."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from plumbline.operators.joins import salted_lookup
from plumbline.operators.ranking import exact_quantiles, with_hash_rank
from plumbline.operators.splits import assign_folds, assign_split, stratified_split
from plumbline.operators.temporal import with_gap


def hot_times(seed, n=3000):
    """Half of all rows belong to one entity and many share an instant."""
    rng = np.random.default_rng(seed)
    entity = np.where(rng.random(n) < 0.5, 0, rng.integers(1, 40, n))
    ts = rng.integers(0, 20, n) * 37_000_000 + rng.choice([0, 0, 1, 500_000], n)
    return pd.DataFrame({"record_id": rng.permutation(n), "entity": entity, "ts_us": ts})


@pytest.mark.parametrize("seed,cell", [(1, 60), (2, 1), (3, 100_000)])
def test_gap_equals_lag(spark, seed, cell):
    pdf = hot_times(seed)
    got = with_gap(spark.createDataFrame(pdf), cell_seconds=cell).toPandas().set_index("record_id").gap
    ordered = pdf.sort_values(["entity", "ts_us", "record_id"])
    want = (ordered.groupby("entity").ts_us.diff() / 1e6).set_axis(ordered.record_id)
    pd.testing.assert_series_equal(got.sort_index(), want.sort_index(), check_names=False)


def test_gap_of_missing_time_or_entity(spark):
    rows = [(1, "a", 10), (2, "a", None), (3, None, 20), (4, "a", 2_000_010)]
    df = spark.createDataFrame(rows, "record_id long, entity string, ts_us long")
    assert {r.record_id: r.gap for r in with_gap(df).collect()} == {1: None, 2: None, 3: None, 4: 2.0}


@pytest.mark.parametrize("digits", [1, 2, 4])
def test_hash_rank_equals_row_number(spark, digits):
    df = spark.range(2000).select(
        F.col("id").alias("k"), F.when(F.col("id") % 10 < 7, "hot").otherwise("cold").alias("c")
    )
    got = with_hash_rank(df, ["c"], "k", 42, digits=digits)
    direct = F.row_number().over(
        Window.partitionBy("c").orderBy(F.md5(F.concat(F.lit("42|"), F.col("k").cast("string"))), "k")
    )
    assert got.withColumn("want", direct).where("rank <> want").count() == 0
    assert {(r.c, r.group_size) for r in got.select("c", "group_size").distinct().collect()} == {
        ("hot", 1400),
        ("cold", 600),
    }


def test_hash_split_fractions_and_seed(spark):
    keys = spark.range(20_000)
    first = assign_split(keys, "id").groupBy("split").count().toPandas().set_index("split")["count"] / 20_000
    assert abs(first["train"] - 0.6) < 0.02 and abs(first["test"] - 0.2) < 0.02
    both = assign_split(keys, "id").join(assign_split(keys, "id", seed=7).withColumnRenamed("split", "other"), "id")
    assert both.where("split = other").count() < 0.6 * 20_000


def test_stratified_split_shares(spark):
    df = spark.range(1000).select("id", F.when(F.col("id") < 900, "a").otherwise("b").alias("c"))
    counts = {
        (r.stratum, r.split): r["count"]
        for r in stratified_split(df, "id", "c").groupBy("stratum", "split").count().collect()
    }
    assert counts == {
        ("a", "train"): 540, ("a", "validation"): 180, ("a", "test"): 180,
        ("b", "train"): 60, ("b", "validation"): 20, ("b", "test"): 20,
    }


def test_folds_cover_and_balance(spark):
    df = spark.range(503).select("id", (F.col("id") % 3 == 0).alias("c"))
    folds = assign_folds(df, "id", "c", k=5, repeats=2).toPandas()
    assert len(folds) == 2 * 503 and not folds.duplicated(["id", "repeat"]).any()
    sizes = folds.groupby(["repeat", "stratum", "fold"]).size().groupby(["repeat", "stratum"])
    assert (sizes.max() - sizes.min() <= 1).all()
    first, second = (folds[folds["repeat"] == r].set_index("id").fold.sort_index() for r in (1, 2))
    assert (first != second).any()


def test_exact_quantiles_on_hot_values(spark):
    """A third of all values are equal, a group is null, one has close values, one a single value."""
    rng = np.random.default_rng(5)
    x = np.where(rng.random(30_000) < 0.34, 7.0, rng.lognormal(2, 2, 30_000).round(3)) * rng.choice([-1, 1, 1], 30_000)
    pdf = pd.DataFrame({"g": np.where(rng.random(30_000) < 0.8, "a", "b"), "x": x})
    close = pd.DataFrame({"g": "c", "x": 1 + rng.permutation(5000) * 2.0**-50})
    few = pd.DataFrame({"g": ["d"] * 3 + [None] * 2 + ["e"], "x": [5e-324, 0.0, 1e300, 2.0, 4.0, 9.0]})
    pdf = pd.concat([pdf, close, few])
    df = spark.createDataFrame(pdf.astype(object).where(pdf.notna(), None), "g string, x double")
    probs = {"q1": 0.25, "q2": 0.5, "q3": 0.75, "q9": 0.99}
    got = {r.g: [r[q] for q in probs] for r in exact_quantiles(df, ["g"], "x", probs).collect()}
    assert got.keys() == {"a", "b", "c", "d", "e", None}
    for g, values in got.items():
        own = pdf[pdf.g.isna()] if g is None else pdf[pdf.g == g]
        assert values == pytest.approx(own.x.quantile(list(probs.values())).tolist(), rel=1e-15), g


def test_exact_quantiles_of_one_large_group(spark):
    df = spark.range(300_000).select(F.lit("a").alias("g"), (F.col("id") / 7.0).alias("x"))
    df = df.unionAll(spark.range(300_000).select(F.lit("b").alias("g"), F.lit(3.5).alias("x")))
    got = {r.g: r.q for r in exact_quantiles(df, ["g"], "x", {"q": 0.5}).collect()}
    assert got == {"a": pytest.approx(149_999.5 / 7), "b": 3.5}


def test_salted_lookup_without_broadcast(spark):
    fact = spark.range(5000).select(
        "id", F.when(F.col("id") % 3 > 0, "hot").otherwise(F.col("id").cast("string")).alias("file")
    )
    side = spark.createDataFrame([("hot", 1), ("0", 2), ("3", 3)], "file string, v int")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = salted_lookup(fact, side, "file", "id").toPandas()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert len(out) == 5000 and out.v.notna().sum() == 3333 + 2
