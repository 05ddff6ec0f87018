"""What a shuffle carries: it must not grow faster than the input, nor hold what can be derived later."""

import glob
import re

import numpy as np
import pandas as pd
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from plumbline.functions.scalars import with_fitted
from plumbline.operators import auctest, logistic, prepare, trees
from plumbline.operators import evaluate as E
from plumbline.operators import experiments as X
from plumbline.operators import baseline
from plumbline.operators.baseline import fit_baseline, score_baseline, tune_baseline
from plumbline.operators.measured import Measured
from plumbline.operators.ranking import with_hash_rank
from plumbline.plans import bindings, catalog
from plumbline.session import stage
from plumbline.spec import ViewSpec


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def noise(n=40_000):
    """Scores that say nothing about the class, all near one value."""
    rng = np.random.default_rng(11)
    return pd.DataFrame({"g": rng.choice(["a", "b"], n), "y": rng.integers(0, 2, n), "s": 0.5 + 1e-4 * rng.normal(size=n)})


def test_thresholds_of_noise_rank_few_scores(spark, monkeypatch):
    pdf, kept = noise(), []
    keep = E.stage
    monkeypatch.setattr(E, "stage", lambda df, name: kept.append(keep(df, name)) or kept[-1])
    got = {r.g: r for r in E.fit_threshold(spark.createDataFrame(pdf), ["g"]).collect()}
    steps = spark.createDataFrame(pdf).select(E.score_step(F.col("s"))).distinct().count()
    assert kept[0].count() < steps / 10
    for g, part in pdf.groupby("g"):
        order = part.sort_values("s", ascending=False)
        tp, fp = order.y.cumsum(), (1 - order.y).cumsum()
        worth = (tp / tp.iloc[-1] - fp / fp.iloc[-1]).round(9)
        assert (got[g].theta, got[g].youden) == (order.s[worth == worth.max()].min(), pytest.approx(worth.max(), abs=1e-9))


def test_counted_scores_are_shuffled_without_what_follows_from_them(spark):
    df = spark.createDataFrame(noise(100)).withColumn("theta", F.lit(0.5))
    shuffled = lambda out: re.findall(r"Exchange hashpartitioning\(([^)]*)", plan_of(out))
    out = E.metrics(df, ["g", "theta"])
    assert not any(c in keys for keys in shuffled(out) for c in ("_fine", "_sse"))
    partial = [line for line in plan_of(out).splitlines() if "partial_count" in line]
    assert partial and not any("_sse" in line or ">= theta" in line for line in partial)
    assert len(shuffled(auctest.auc_interval(df, ["g"]))) <= 4


def test_metrics_of_one_threshold_or_many_agree(spark):
    rng = np.random.default_rng(2)
    pdf = pd.DataFrame({"g": rng.choice(["a", "b"], 400), "y": rng.integers(0, 2, 400), "s": rng.integers(0, 9, 400) / 8})
    df = spark.createDataFrame(pdf).withColumn("s", F.when(F.col("s") != 0.25, F.col("s")))
    theta = spark.createDataFrame([("a", 0.5)], "g string, theta double")
    rows = with_fitted(df, theta, ["g"], ["theta"])
    one, many = (E.metrics(rows, by).drop("theta").toPandas().set_index("g").sort_index() for by in (["g", "theta"], ["g"]))
    pd.testing.assert_frame_equal(one, many, check_exact=False, rtol=1e-12)
    assert one.tp.b == 0 and one.n_unscored.sum() == pdf.s.eq(0.25).sum()


def test_interval_equals_components_row_by_row(spark):
    pdf = noise(600).assign(s=lambda d: d.s.round(5) + 1e-5 * d.y)
    got = {r.g: r for r in auctest.auc_interval(spark.createDataFrame(pdf), ["g"]).collect()}
    for g, part in pdf.groupby("g"):
        p, n = part.s[part.y == 1].to_numpy(), part.s[part.y == 0].to_numpy()
        wins = (p[:, None] > n).astype(float) + (p[:, None] == n) / 2
        se = (wins.mean(1).var(ddof=1) / len(p) + wins.mean(0).var(ddof=1) / len(n)) ** 0.5
        assert (got[g].auc, got[g].se) == (pytest.approx(wins.mean(), abs=1e-12), pytest.approx(se, rel=1e-9))


def test_fitted_values_reach_rows_by_hash(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "a"), (None, "b"), (3, "c")], "k int, v string")
    fitted = spark.createDataFrame([(1, "a", 0.1), (None, "b", 0.2), (3, "x", 0.3)], "k int, v string, x double")
    out = with_fitted(rows, fitted, ["k", "v"], ["x"])
    assert "BroadcastHashJoin" in plan_of(out) and "to_json" not in plan_of(out)
    assert out.columns == ["k", "v", "x"]
    assert {(r.k, r.v): r.x for r in out.collect()} == {(1, "a"): 0.1, (2, "a"): None, (None, "b"): 0.2, (3, "c"): None}
    models = [{"k": 1, "mu": [0.0], "sd": [1.0], "b": [0.0, 2.0]}]
    assert "BroadcastHashJoin" in plan_of(logistic._attached(rows, models, ["k"], logistic._MODEL))


def test_keys_are_compared_by_hash_and_then_themselves(spark, monkeypatch):
    asked = []
    count = prepare.duplicate_keys
    monkeypatch.setattr(prepare, "duplicate_keys", lambda df, key: asked.append(key) or count(df, key))
    rows = lambda *keys: spark.createDataFrame([(k,) for k in keys], "id string")
    prepare.require_unique(rows("a", "b", None), "id")
    assert asked == ["_h"]
    for twice in (rows("a", "b", "a"), rows("a", None, None)):
        with pytest.raises(ValueError, match="occurs 2 times"):
            prepare.require_unique(twice, "id")
    monkeypatch.setattr(prepare.F, "xxhash64", lambda c: F.length(c))  # every hash meets another one
    prepare.require_unique(rows("a", "b", "c"), "id")


def test_baselines_score_after_measured_stages(spark, tmp_path):
    """A model with a training summary is sent to tasks after stages were measured."""
    own = spark.newSession()  # what a session has observed stays with it
    run = Measured(own, "r")
    kept = run.stage(own.range(100).selectExpr("id", "id % 2 AS part"), "numbers", ("part",))
    assert kept.count() == 100 and [e[:3] for e in run.entries] == [("r", "numbers", 100)]
    df = own.range(60).selectExpr("cast(id AS double) AS x", "cast(id >= 30 AS int) AS y", "id % 7 AS z")
    out = score_baseline(df, fit_baseline(df, ["x"], "logistic_regression"), ["y"])
    assert {r.pred == r.y for r in out.collect()} == {True}


def test_splits_are_looked_up_by_their_number(spark):
    spec = ViewSpec({"a": ("x",), "b": ("z",)})
    df = spark.range(400).selectExpr("cast(id AS double) AS x", "cast(id % 3 AS double) AS z", "cast(id >= 170 AS int) AS y")
    scored = trees.score_views(df, spec, trees.fit_trees(df, spec))
    rows = plan_of(scored).split("Subquery")[0]
    assert "try_element_at" not in rows and "element_at" not in rows
    assert scored.where("x < 150 AND p_a > 0.1 OR x >= 200 AND p_a < 0.9").count() == 0


def test_ranks_shuffle_digests_as_bytes(spark):
    ranked = with_hash_rank(spark.range(20).withColumn("c", F.lit("x")), ["c"], "id", 42)
    assert "unhex" in plan_of(ranked)


@pytest.fixture
def lines(spark, tmp_path):
    """A folder with 600 lines of 200 orders."""
    orders = spark.range(200).selectExpr(
        "id AS o_orderkey", "timestamp'1995-01-01' + make_dt_interval(cast(id AS int)) AS o_orderdate",
        "element_at(array('F', 'O', 'P'), cast(id % 3 AS int) + 1) AS o_orderstatus",
    )
    lineitem = spark.range(600).selectExpr(
        "id % 200 AS l_orderkey", "id % 37 AS l_partkey", "id % 11 AS l_suppkey", "id AS l_linenumber",
        "cast(id * 7 % 50 AS double) AS l_quantity", "cast(id * 13 % 901 AS double) AS l_extendedprice",
        "(id % 11) / 100D AS l_discount", "(id % 9) / 100D AS l_tax",
        "element_at(array('A', 'N', 'R'), cast(id * 7 % 3 AS int) + 1) AS l_returnflag", "if(id % 2 = 0, 'F', 'O') AS l_linestatus",
        "timestamp'1995-02-01' + make_dt_interval(cast(id % 300 AS int)) AS l_shipdate",
    )
    for name, df in (("orders", orders), ("lineitem", lineitem)):
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


def test_measured_stages_join_lines_once(spark, lines, monkeypatch):
    joins, checked = [], []
    join, check = bindings.line_records, prepare.require_unique
    monkeypatch.setattr(bindings, "line_records", lambda *a: joins.append(a) or join(*a))
    for module in (bindings, prepare):
        monkeypatch.setattr(module, "require_unique", lambda df, key: checked.append(key) or check(df, key))
    rows = catalog.measured_stages(spark, lines).collect()
    assert len(joins) == 1 and checked == ["record_id"]
    total = {r.stage: (r.stage_runs, r.stage_rows) for r in rows}
    assert total == {"records": (1, 600), "evidence": (1, 600), "scores": (3, 600)}
    again = spark.read.parquet(f"{lines}/lineitem.parquet").limit(1)
    again.write.mode("append").parquet(f"{lines}/lineitem.parquet")
    with pytest.raises(ValueError, match="occurs 2 times"):
        catalog.measured_stages(spark, lines)


def test_baselines_share_a_preparation_and_score_what_is_used(spark, lines, monkeypatch):
    fits, scored = [], []
    fit, keep = baseline.StandardScaler._fit, catalog.stage
    monkeypatch.setattr(baseline.StandardScaler, "_fit", lambda self, df: fits.append(1) or fit(self, df))
    monkeypatch.setattr(catalog, "stage", lambda df, name, *by: scored.append(keep(df, name, *by)) or scored[-1])
    some = {n: baseline.ESTIMATORS[n] for n in ("logistic_regression", "decision_tree")}
    monkeypatch.setattr(catalog, "ESTIMATORS", some)
    assert {r.variant for r in catalog.baseline_models(spark, lines).collect()} == set(some)
    assert len(fits) == 1 and {r.split for r in scored[0].select("split").distinct().collect()} == {"validation", "test"}
    df = spark.range(60).selectExpr("cast(id AS double) AS x", "cast(id >= 30 AS int) AS y")
    grid = [{"maxDepth": 0}, {"maxDepth": 2}]
    assert [r.chosen for r in tune_baseline(df, df, ["x"], "decision_tree", grid).orderBy("grid_id").collect()] == [False, True]
    assert len(fits) == 2


def test_staged_tables_are_written_small(spark):
    """Keys of many digits are most of what is staged."""
    keys = spark.range(20000).select(F.concat_ws("|", *[F.pmod(F.xxhash64("id", F.lit(k)), F.lit(10000)).cast("string") for k in range(4)]).alias("key"))
    table = stage(keys, "codec")
    folder = table.inputFiles()[0].removeprefix("file://").rsplit("/", 1)[0]
    kinds = {pq.ParquetFile(f).metadata.row_group(0).column(0).compression for f in glob.glob(f"{folder}/*.parquet")}
    assert kinds == {"ZSTD"}
    assert table.exceptAll(keys).count() == 0 and table.count() == 20000


@pytest.fixture(scope="module")
def degraded(spark):
    """Rows with ties, rows without any feature, and a class that is unknown; one fitted row of each kind."""
    spec = ViewSpec({"a": ("x",), "b": ("z",)})
    df = spark.range(500).selectExpr(
        "cast(id AS string) AS record_id", "cast(nullif(id % 6, 5) > 2 AS int) AS y",
        "if(id % 9 = 0, null, cast(id % 7 + id % 6 AS double)) AS x", "if(id % 18 = 0, null, id * 0.37 % 5) AS z", "0.5 AS i", "0.25 AS t",
    )
    constants = X.score_constants(X.fit_view_params(df, spec), spec)
    theta = spark.createDataFrame([("unweighted", 0.5), ("reliability", 0.6), ("one", None)], "variant string, theta double")
    return spec, X.with_scalar(df, constants, "_P"), theta


def curve_of(degraded, rates=(0.0, 0.3, 1.0)):
    spec, rows, theta = degraded
    g, alpha, one = {"a": F.lit(0.3), "b": F.lit(0.2)}, (0.2, 0.5, 0.3), {"one": X.gaussian_baseline(spec)}
    return X.degradation_curve(rows, spec, g, alpha, theta, 1, rates=rates, baselines=one)


@pytest.mark.parametrize("size", [1 << 19, 40])
def test_degradation_ranks_ranges_of_scores(spark, degraded, monkeypatch, size):
    spec, rows, theta = degraded
    monkeypatch.setattr(X, "RANGE", size)
    monkeypatch.setattr(X, "CHUNK", 100)
    got = {(r.variant, r.view, r.rate): r for r in curve_of(degraded).collect()}
    limits = {r.variant: r.theta for r in theta.collect()}
    assert len(got) == 3 * 2 * 3
    for view in spec.names:
        for rate in (0.0, 0.3, 1.0):
            hit = X.degrade(rows.where("y IS NOT NULL"), spec, F.lit(view), F.lit(rate), 1)
            hit = X.fuse(X.with_quality(X.with_scores(hit, spec), spec), spec, {"a": F.lit(0.3), "b": F.lit(0.2)}, (0.2, 0.5, 0.3))
            pdf = hit.select("y", X.unweighted(spec).alias("unweighted"), F.col("s").alias("reliability"), X.gaussian_baseline(spec).alias("one")).toPandas()
            for name, theta_ in limits.items():
                r, s = got[name, view, rate], pdf[name].fillna(E.UNSCORED).to_numpy()
                p, n = s[pdf.y == 1], s[pdf.y == 0]
                wins = (p[:, None] > n).mean() + (p[:, None] == n).mean() / 2
                assert (r.n, r.n_unscored) == (len(s), pdf[name].isna().sum())
                assert (r.tp, r.fp) == ((0, 0) if theta_ is None else ((p >= theta_).sum(), (n >= theta_).sum()))
                assert r.auc == pytest.approx(wins, abs=1e-12)
                assert r.brier == pytest.approx(((pdf[name] - pdf.y) ** 2).mean(), rel=1e-12)
    assert all(got[k].auc_loss == pytest.approx(got[(*k[:2], 0.0)].auc - r.auc) for k, r in got.items())


def test_degradation_shuffles_no_row_per_score(degraded):
    keys = re.findall(r"Exchange hashpartitioning\(([^)]*)", plan_of(curve_of(degraded)))
    assert keys and not any(c in k for k in keys for c in ("_s#", "_step", "_fine"))


def test_variants_are_computed_outside_their_generator(spark):
    out = X.score_variants(spark.range(4), {"a": F.exp(F.col("id")), "b": F.sqrt("id")}, ["id"])
    generators = [line for line in plan_of(out).splitlines() if "Generate" in line]
    assert generators and not any("EXP" in line or "SQRT" in line for line in generators)
    assert {(r.variant, round(r.s, 6)) for r in out.where("id = 1").collect()} == {("a", 2.718282), ("b", 1.0)}


def test_baselines_score_in_one_pass(spark, tmp_path):
    path = str(tmp_path / "rows")
    spark.range(80).selectExpr("id", "nullif(cast(id % 13 AS double), 4) AS x", "cast(id % 5 AS double) AS z", "cast(id % 13 > 6 AS int) AS y").write.parquet(path)
    df, names = spark.read.parquet(path), ["naive_bayes", "decision_tree", "logistic_regression"]
    prepared = baseline.fit_preparation(df, ["x", "z"])
    models = {n: fit_baseline(df, ["x", "z"], n, prepared=prepared) for n in names}
    out = baseline.score_baselines(df, models, ["id", "y"])
    assert plan_of(out).count("FileScan") == 1
    each = [score_baseline(df, models[n], ["id", "y"]).withColumn("variant", F.lit(n)) for n in names]
    want = each[0].unionByName(each[1]).unionByName(each[2])
    assert out.columns == want.columns and out.count() == 240
    assert out.exceptAll(want).count() == 0
