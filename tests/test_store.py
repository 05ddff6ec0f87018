"""The result store and the recorded lineage."""

import threading

import pytest
from pyspark.sql import functions as F

from plumbline.operators import consolidate as C
from plumbline.operators import store as S
from plumbline.plans import bindings as B
from plumbline.plans import catalog
from plumbline.session import side_by_side


def results(spark, values, output="clean_ablation", experiment=4):
    df = spark.createDataFrame([(k, float(v)) for k, v in values], "variant string, auc double")
    return C.as_results(df, experiment, output, F.lit("lines"), F.col("variant"), ["auc"])


def stored(spark, path, runs):
    return {r["subject"]: r["value"] for r in S.read_results(spark, path, runs).collect()}


def test_recording_again_replaces_and_adds_nothing(spark, tmp_path):
    path = str(tmp_path / "store")
    S.record_results(results(spark, [("x", 0.1), ("y", 1 / 3)]), path, "r1")
    S.record_results(results(spark, [("x", 0.2)]), path, "r1")
    assert stored(spark, path, ["r1"]) == {"x": 0.2, "y": 1 / 3}  # full precision


def test_the_last_named_run_wins(spark, tmp_path):
    path = str(tmp_path / "store")
    S.record_results(results(spark, [("x", 0.1), ("y", 0.5)]), path, "r1")
    S.record_results(results(spark, [("x", 0.9)]), path, "r2")
    assert stored(spark, path, ["r1", "r2"]) == {"x": 0.9, "y": 0.5}
    assert stored(spark, path, ["r2", "r1"]) == {"x": 0.1, "y": 0.5}
    assert stored(spark, path, ["r2"]) == {"x": 0.9}


def chain(without=()):
    """Two tables -> evidence -> parameters and evidence -> results."""
    steps = S.Steps()
    for output, inputs in [
        ("stage:evidence", ["table:a", "table:b"]),
        ("stage:params", ["stage:evidence"]),
        ("result:4/clean_ablation", ["stage:params", "stage:evidence"]),
    ]:
        if output not in without:
            steps.begin()
            for i in inputs:
                steps.uses(i)
            steps.end(output, "made", {"seed": 1}, 5)
    for t, n in (("table:a", 10), ("table:b", 20)):
        steps.rows[t, None] = (t, None, "source", "{}", n)
    return steps


def traced(spark, path, steps):
    S.record_steps(spark, steps, path, "r1")
    rows = S.trace_results(results(spark, [("x", 0.1)]), S.read_steps(spark, path, ["r1"])).collect()
    return sorted(((r["source"], r["steps"], r["source_rows"]) for r in rows), key=str)


def test_every_result_reaches_its_tables(spark, tmp_path):
    assert traced(spark, str(tmp_path / "s"), chain()) == [("table:a", 2, 10), ("table:b", 2, 20)]


def test_a_removed_step_breaks_the_chain(spark, tmp_path):
    assert traced(spark, str(tmp_path / "s"), chain(without=["stage:evidence"])) == [(None, None, None)]
    assert traced(spark, str(tmp_path / "t"), chain(without=["result:4/clean_ablation"])) == [(None, None, None)]


def test_steps_know_what_is_used_while_they_are_built():
    steps = S.Steps()
    steps.uses("table:lost")  # nothing is being built
    steps.begin()
    steps.uses("table:a")
    steps.begin()
    steps.uses("table:b")
    steps.end("stage:inner", "f")
    steps.uses("stage:inner")
    steps.end("stage:outer", "g")
    assert sorted(steps.rows) == [("stage:inner", "table:b"), ("stage:outer", "stage:inner"), ("stage:outer", "table:a")]


def test_consolidation_fits_nothing(spark, tmp_path, monkeypatch):
    """C3 to C7 with a store at hand, while every experiment and fit is forbidden."""
    path = str(tmp_path / "store")
    S.record_results(results(spark, [("x", 0.5)]), path, catalog.RUN)
    S.record_results(results(spark, [("g", 0.4)], "baseline_results", 2), path, catalog.RUN)
    S.record_steps(spark, chain(), path, catalog.RUN)

    def forbidden(*_, **__):
        raise AssertionError("fitted during consolidation")

    monkeypatch.setattr(catalog, "recorded_store", lambda *_: path)
    for module in (catalog.E, catalog.X, catalog.scoring, catalog.fusion, catalog.logistic, catalog.B):
        for name in dir(module):
            if name.startswith(("fit", "score", "load", "once", "cv_", "metrics")):
                monkeypatch.setattr(module, name, forbidden)
    for query in ("consolidated_results", "claims_to_evidence", "output_index", "result_lineage", "publication_table"):
        assert catalog.QUERIES[query](spark, "nowhere").count() > 0
    matrix = {r["claim_id"]: r for r in catalog.claims_to_evidence(spark, "nowhere").collect()}
    assert matrix["c6"]["experiment_2"] == 1.0 and matrix["c2"]["experiment_4"] == 1.0


def test_a_repeated_id_within_one_output_fails(spark):
    one = results(spark, [("x", 0.5)])
    with pytest.raises(Exception, match="repeated result id"):
        C.consolidate([one, one]).collect()


def test_experiments_side_by_side_share_what_they_need(spark, tmp_path):
    """Two that need one table at a time build it once, and each step keeps its own inputs."""
    folder, built, meet = str(tmp_path), [], threading.Barrier(2, timeout=30)

    def shared():
        built.append(1)
        return spark.range(3)

    def ran(name):
        steps = B.steps_of(spark, folder)
        steps.begin()
        meet.wait()
        steps.uses(f"table:{name}")
        n = B.once(spark, folder, "shared", shared).count()
        meet.wait()
        return n, steps.drop()

    got = list(side_by_side(spark, [lambda: ran("a"), lambda: ran("b")]))
    assert built == [1]
    assert got == [(3, {"table:a", "stage:shared"}), (3, {"table:b", "stage:shared"})]


def test_failed_call_is_raised(spark):
    def fails():
        raise ValueError("no rows")

    with pytest.raises(ValueError, match="no rows"):
        list(side_by_side(spark, [lambda: 1, fails, lambda: 2]))
