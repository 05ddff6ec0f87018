"""Evaluation, statistics and consolidation on tiny tables."""

import itertools

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from plumbline.operators import consolidate as C
from plumbline.operators import evaluate as E
from plumbline.operators import stats
from plumbline.operators.describe import assess, merged_assessment, part_sketches, store_sketches


def brute_auc(y, s):
    pairs = [(a, b) for a, b in itertools.product(s[y == 1], s[y == 0])]
    return sum((a > b) + 0.5 * (a == b) for a, b in pairs) / len(pairs)


@pytest.mark.parametrize("seed", [0, 1])
def test_auc_counts_ties_as_half(spark, seed):
    rng = np.random.default_rng(seed)
    pdf = pd.DataFrame({"y": rng.integers(0, 2, 200), "s": rng.integers(0, 12, 200) / 11})
    got = E.auc(spark.createDataFrame(pdf)).first().auc
    assert got == pytest.approx(brute_auc(pdf.y.values, pdf.s.values), abs=1e-12)


def test_auc_without_one_class_is_null(spark):
    df = spark.createDataFrame([(1, 0.5), (1, 0.7)], "y int, s double")
    assert E.auc(df).first().auc is None


def test_metrics_agree_with_confusion(spark):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"g": rng.choice(["a", "b"], 500), "y": rng.integers(0, 2, 500), "s": rng.random(500)})
    df = spark.createDataFrame(pdf).withColumn("theta", F.lit(0.4))
    got = {r.g: r for r in E.metrics(df, ["g"]).collect()}
    direct = E.rates(E.confusion(df.withColumn("pred", (F.col("s") >= 0.4).cast("int")), by=["g"]))
    for r in direct.collect():
        for c in ("tp", "fp", "tn", "fn", "accuracy", "precision", "recall", "f1", "mcc"):
            assert got[r.g][c] == pytest.approx(r[c])
    part = pdf[pdf.g == "a"]
    assert got["a"].brier == pytest.approx(((part.s - part.y) ** 2).mean())
    assert got["a"].auc == pytest.approx(brute_auc(part.y.values, part.s.values), abs=1e-12)


@pytest.mark.parametrize("metric", ["youden", "f1"])
def test_threshold_is_the_best_edge(spark, metric):
    rng = np.random.default_rng(4)
    y = rng.integers(0, 2, 400)
    s = np.clip(0.3 * y + rng.random(400) * 0.6, 0, 1)
    got = E.fit_threshold(spark.createDataFrame(pd.DataFrame({"y": y, "s": s})), metric=metric).first()

    def value(th):
        tp, fp = ((s >= th) & (y == 1)).sum(), ((s >= th) & (y == 0)).sum()
        if metric == "youden":
            return tp / (y == 1).sum() - fp / (y == 0).sum()
        return 2 * tp / (tp + fp + (y == 1).sum())

    assert got[metric] == pytest.approx(max(value(t) for t in s), abs=1e-9)
    assert value(got.theta) == pytest.approx(got[metric], abs=1e-9)


def test_close_scores_that_separate(spark):
    """All scores lie within 1e-4, and in one hundredth."""
    rows = [(1, 0.05 + 1e-4 + k * 1e-9) for k in range(50)] + [(0, 0.05 + k * 1e-9) for k in range(60)]
    df = spark.createDataFrame(rows, "y int, s double")
    best = E.fit_threshold(df).first()
    assert best.youden == 1.0 and best.theta == rows[0][1]
    got = E.metrics(df.withColumn("theta", F.lit(best.theta)).withColumn("g", F.lit(1)), ["g"]).first()
    assert (got.auc, got.recall, got.specificity) == (1.0, 1.0, 1.0)
    assert E.auc(df).first().auc == 1.0


def test_missing_scores_are_not_detected(spark):
    rows = [("a", 1, 0.9), ("a", 1, None), ("a", 0, 0.1), (None, 1, 0.8), (None, 0, None)]
    df = spark.createDataFrame(rows, "g string, y int, s double").withColumn("theta", F.lit(0.5))
    got = {r.g: r for r in E.metrics(df, ["g"]).collect()}
    assert (got["a"].n, got["a"].n_unscored, got["a"].recall, got["a"].auc) == (3, 1, 0.5, 0.5)
    assert (got[None].n, got[None].n_unscored, got[None].specificity, got[None].auc) == (2, 1, 1.0, 1.0)
    assert {r.g: r.theta for r in E.fit_threshold(df, by=["g"]).collect()} == {"a": 0.9, None: 0.8}


def test_per_class(spark):
    df = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b"), ("c", "b")], "y string, yhat string")
    rows = {r["class"]: r for r in E.per_class(df).collect()}
    assert (rows["b"].precision, rows["b"].recall) == (pytest.approx(1 / 3), 1.0)
    assert rows["c"].precision is None and rows["c"].recall == 0.0


def scores(spark, diffs):
    rows = [
        (m, r, f, 0.5 + (d if m == "a" else 0.0))
        for (r, f), d in zip(itertools.product(range(1, 3), range(5)), diffs)
        for m in ("a", "b")
    ]
    return spark.createDataFrame(rows, "model string, repeat int, fold int, value double").withColumn("metric", F.lit("auc"))


def test_equal_scores_give_no_division_error(spark):
    d = stats.paired(scores(spark, [0.0] * 10), "a", "b", ["metric"])
    t = stats.paired_t(d, ["metric"]).first()
    assert (t.mean_diff, t.t, t.effect_size) == (0.0, None, None)
    assert stats.signed_rank(d, ["metric"]).count() == 0
    assert stats.permutation_p(d, ["metric"], 50).first().p == 1.0


def test_paired_statistics_by_hand(spark):
    diffs = [0.1, 0.2, -0.1, 0.3, 0.05, 0.2, 0.1, 0.0, 0.15, 0.25]
    d = stats.paired(scores(spark, diffs), "a", "b", ["metric"])
    t = stats.paired_t(d, ["metric"]).first()
    x = np.array(diffs)
    assert t.t == pytest.approx(x.mean() / (x.std(ddof=1) / np.sqrt(10)))
    w = stats.signed_rank(d, ["metric"]).first()
    ranks = pd.Series(np.abs(x[x != 0])).round(9).rank()
    assert w.w_minus == pytest.approx(ranks[x[x != 0] < 0].sum()) and w.w_plus == pytest.approx(ranks[x[x != 0] > 0].sum())
    counts = pd.Series(np.abs(x[x != 0]).round(9)).value_counts()
    spread = np.sqrt(9 * 10 * 19 / 24 - (counts**3 - counts).sum() / 48)
    assert w.z == pytest.approx((w.w_plus - 9 * 10 / 4) / spread)
    p = stats.permutation_p(d, ["metric"], 500).first()
    assert 0 < p.p < 0.05 and p.p == (p.extreme + 1) / 501


def test_student_values(spark):
    """Known points of the distribution, odd and even degrees of freedom."""
    known = [(1, 12.7062, 0.05), (2, 4.30265, 0.05), (3, 3.18245, 0.05), (14, 2.14479, 0.05), (15, 2.94671, 0.01), (100, 1.98397, 0.05), (1, 1.0, 0.5), (2, 0.0, 1.0)]
    df = spark.createDataFrame(known, "df long, t double, p double")
    rows = df.select("*", stats.student_p(F.col("t"), F.col("df")).alias("got"), stats.student_p(-F.col("t"), F.col("df")).alias("other")).collect()
    for r in rows:
        assert r.got == pytest.approx(r.p, abs=2e-5) and r.other == r.got
    bounds = {r.df: r.b for r in df.select("df", stats.student_bound(F.col("df")).alias("b")).distinct().collect()}
    assert bounds[14] == pytest.approx(2.1447866879, abs=1e-9) and bounds[1] == pytest.approx(12.7062047364, abs=1e-8)
    one = scores(spark, [0.1] * 10).where("repeat = 1 and fold = 0")
    assert stats.summarize_scores(one, ["model"]).first().ci_low is None


def test_efficiency_and_growth(spark):
    log = spark.createDataFrame(
        [("fit", 10, 1.0), ("fit", 10, 3.0), ("fit", 20, 5.0), ("idle", 0, 0.0)], "stage string, rows long, seconds double"
    )
    e = {r.stage: r for r in stats.efficiency(log).collect()}
    assert (e["fit"].median_seconds, e["fit"].rows_per_second) == (3.0, pytest.approx(40 / 9))
    assert e["idle"].rows_per_second is None
    s = {(r.stage, r.rows): r for r in stats.scalability(log).collect()}
    assert (s["fit", 20].size_ratio, s["fit", 20].time_ratio) == (2.0, 2.5)


def result_table(spark, values):
    df = spark.createDataFrame([(k, float(v)) for k, v in values], "variant string, auc double")
    return C.as_results(df, 4, "clean_ablation", F.lit("d"), F.col("variant"), ["auc"])


def test_consolidation_adds_nothing(spark):
    one, two = result_table(spark, [("x", 0.5)]), result_table(spark, [("y", 0.7)])
    out = C.consolidate([one, two])
    assert sorted(out.collect()) == sorted(one.unionByName(two).select(*out.columns).collect())
    with pytest.raises(Exception, match="repeated result id"):
        C.consolidate([one, one]).collect()


def test_tables_come_from_stored_numbers(spark):
    out = C.consolidate([result_table(spark, [("x", 0.5), ("y", 0.7)])])
    table = {r.subject: r.auc for r in C.publication_table(out, "clean_ablation", ["auc"]).collect()}
    assert table == {"x": 0.5, "y": 0.7}


def test_claim_without_evidence_keeps_its_row(spark):
    results = result_table(spark, [("x", 0.5), ("y", 0.6)])
    claims = spark.createDataFrame(
        [("c1", "t1", "clean_ablation", "auc"), ("c2", "t2", "nowhere", "auc")],
        "claim_id string, text string, output string, metric string",
    )
    rows = {r.claim_id: r for r in C.claims_matrix(claims, C.link_evidence(claims, results)).collect()}
    assert rows["c1"].experiment_4 == 2 and rows["c1"].experiment_3 is None
    assert all(v is None for k, v in rows["c2"].asDict().items() if k.startswith("experiment_"))
    index = {r.output: r.n_results for r in C.results_index(results).collect()}
    assert index["clean_ablation"] == 2 and index["view_validation"] == 0
    assert C.missing_outputs(results).count() == len(C.EXPERIMENTS) - 1


def test_assessment(spark):
    long = "x" * 70
    rows = [(1, "d", long, 1.0), (2, "d", long, 1.0), (3, "d", "s", float("nan")), (4, "d", None, None)]
    df = spark.createDataFrame(rows, "id long, ds string, t string, v double")
    got = {r.column: (r.rows, r.nulls, r.non_finite, r.distinct) for r in assess(df, ["t", "v"], "ds", "id").collect()}
    assert got == {"t": (4, 1, 0, 2), "v": (4, 1, 1, 2), "*": (4, 0, 0, 3)}
    approx = {r.column: r.distinct for r in assess(df, ["t"], "ds", "id", approximate=True).collect()}
    assert approx == {"t": 2, "*": 3}


def crowded(n=100_000):
    """Scores within 1e-9 of 1, and as many within 1e-3 of one half."""
    rng = np.random.default_rng(8)
    y = rng.integers(0, 2, 2 * n)
    near_one = 1 - 1e-9 * np.clip(rng.random(n) - 0.2 * y[:n], 1e-3, None)
    middle = 0.5 + 1e-3 * np.clip(rng.random(n) - 0.5 + 0.1 * y[n:], -0.5, 0.5)
    return pd.DataFrame({"g": ["one"] * n + ["half"] * n, "y": y, "s": np.concatenate([near_one, middle])})


def test_crowded_scores_have_no_hot_cell_and_exact_ranks(spark):
    pdf = crowded()
    df = spark.createDataFrame(pdf)
    hist = E.score_histogram(df, ["g"])
    assert hist.groupBy("g", "_cell", "_fine").count().agg(F.max("count")).first()[0] < 200
    got = {r.g: r for r in E.auc(df, ["g"]).collect()}
    best = {r.g: r for r in E.fit_threshold(df, ["g"]).collect()}
    for g, part in pdf.groupby("g"):
        ranks, pos = part.s.rank()[part.y == 1], (part.y == 1).sum()
        area = (ranks.sum() - pos * (pos + 1) / 2) / (pos * (len(part) - pos))
        assert got[g].auc == pytest.approx(area, abs=1e-12)
        order = part.sort_values("s", ascending=False)
        tp, fp = order.y.cumsum(), (1 - order.y).cumsum()
        last = order.s != order.s.shift(-1)
        worth = (tp / tp.iloc[-1] - fp / fp.iloc[-1])[last].round(9)
        assert best[g].youden == pytest.approx(worth.max(), abs=1e-9)
        assert best[g].theta == order.s[last][worth == worth.max()].min()


def test_cells_never_fall_as_the_score_rises(spark):
    rng = np.random.default_rng(3)
    odds = rng.normal(0, 15, 3000)
    s = np.unique(np.concatenate([1 / (1 + np.exp(-odds)), [0.0, 1.0, -1.0, 5e-324, 1e-300, np.nextafter(1, 0)]]))
    cell, fine = E.score_cells("s")
    rows = spark.createDataFrame(pd.DataFrame({"s": s})).select("s", cell.alias("c"), fine.alias("f")).toPandas()
    rows = rows.sort_values("s")
    place = rows.c.astype(object) * E.FINE + rows.f.astype(object)
    assert (place.diff().dropna() >= 0).all() and rows.f.between(0, E.FINE - 1).all()


def test_thresholds_of_coarse_cells_are_those_of_all_scores(spark, monkeypatch):
    """Many scores share a cell, so that bounds and ties decide."""
    monkeypatch.setattr(E, "CELLS", 1)
    monkeypatch.setattr(E, "FINE", 4)
    rng = np.random.default_rng(6)
    parts = []
    for g in range(12):
        n = int(rng.integers(2, 60))
        parts.append(pd.DataFrame({"g": g, "y": rng.integers(0, 2, n), "s": rng.choice([0.0, 0.1, 0.3, 0.31, 0.5, 0.52, 0.9, 1.0], n)}))
    pdf = pd.concat(parts)
    for metric in ("youden", "f1"):
        for r in E.fit_threshold(spark.createDataFrame(pdf), ["g"], metric=metric).collect():
            p = pdf[pdf.g == r.g]
            pos, neg = (p.y == 1).sum(), (p.y == 0).sum()
            worth = {}
            for t in set(p.s):
                tp, fp = ((p.s >= t) & (p.y == 1)).sum(), ((p.s >= t) & (p.y == 0)).sum()
                ok = pos and (neg or metric == "f1")
                worth[t] = round(tp / pos - fp / neg if metric == "youden" else 2 * tp / (tp + fp + pos), 9) if ok else -1.0
            if metric == "f1" and not pos:  # the base is the predicted negatives
                worth = dict.fromkeys(worth, 0.0)
            top = max(worth.values())
            assert (r.theta, r[metric]) == (min(t for t in worth if worth[t] == top), top)


def test_sketches_of_parts_add_up_to_those_of_the_whole(spark, tmp_path):
    n = 20_000
    value = F.when(F.col("id") % 50 == 0, None).when(F.col("id") % 97 == 0, float("nan")).otherwise((F.col("id") * 7 % 9000).cast("double"))
    df = spark.range(n).select(
        "id", F.when(F.col("id") % 3 > 0, "hot").alias("ds"), (F.col("id") % 5).cast("string").alias("file"), value.alias("v"),
        F.when(F.col("id") % 4 > 0, F.concat(F.lit("t"), F.col("id") % 100)).alias("t"),
    )
    parts = part_sketches(df, ["t", "v"], "ds", "id", "file")
    path = str(tmp_path / "sketches")
    store_sketches(parts.where("part < '3'"), path)
    store_sketches(parts.where("part >= '2'"), path)  # part 2 arrives again
    merged = merged_assessment(spark.read.schema(parts.schema).parquet(path), "ds", {"p50": 0.5})
    got = {(r.ds, r.column): r for r in merged.collect()}
    exact = {(r.ds, r.column): r for r in assess(df.drop("file"), ["t", "v"], "ds", "id").collect()}
    assert got.keys() == exact.keys()
    for k, e in exact.items():
        assert (got[k].rows, got[k].nulls, got[k].non_finite) == (e.rows, e.nulls, e.non_finite)
        assert abs(got[k].distinct - e.distinct) <= 0.04 * e.distinct
    middle = df.where("ds = 'hot' and v is not null and not isnan(v)").selectExpr("avg(cast(v <= %r as int))" % got["hot", "v"].p50)
    assert abs(middle.first()[0] - 0.5) < 0.03 and got["hot", "t"].p50 is None
    none = merged_assessment(part_sketches(df.limit(0), ["t", "v"], "ds", "id", "file"), "ds")
    assert none.count() == 0
