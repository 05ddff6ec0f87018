"""CSV input, manifests, sinks and models."""

import hashlib

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.operators.baseline import ESTIMATORS, fit_baseline, score_baseline, tune_baseline
from plumbline.operators.integrity import attach_integrity, integrity_factor, verify_integrity
from plumbline.operators.prepare import clean, harmonize, require_unique
from plumbline.sources import flows, manifest, sinks
from plumbline.spec import FlowMapping

SCHEMA = T.StructType(
    [
        T.StructField("Flow ID", T.LongType()),
        T.StructField("Flow Bytes/s", T.DoubleType()),
        T.StructField("Label", T.StringType()),
    ]
)
NAMES = {"Flow ID": "record_id", "Flow Bytes/s": "rate", "Label": "class"}


@pytest.fixture
def root(tmp_path):
    for name, lines in {
        "set one": ["1,2.5,BENIGN", "2,Infinity,DoS", "3,oops,DoS"],
        "set+two": ["4,NaN,Benign", '5,7,"Web, ""x"""'],
    }.items():
        (tmp_path / name).mkdir()
        (tmp_path / name / "part a.csv").write_text("\n".join(["Flow ID,Flow Bytes/s,Label", *lines]) + "\n")
    return tmp_path


def test_read_datasets(spark, root):
    rows = {r.record_id: r for r in flows.read_datasets(spark, str(root), SCHEMA, NAMES).collect()}
    assert {k: r.dataset for k, r in rows.items()} == {1: "set one", 2: "set one", 3: "set one", 4: "set+two", 5: "set+two"}
    assert rows[3].rate is None and rows[3][flows.CORRUPT] == "3,oops,DoS" and rows[3]["class"] == "DoS"
    assert rows[5]["class"] == 'Web, "x"' and rows[1][flows.CORRUPT] is None
    assert rows[2].rate == float("inf")


def test_columns_are_bound_by_header(spark, tmp_path):
    (tmp_path / "d" / "deep").mkdir(parents=True)
    (tmp_path / "d" / "one.csv").write_text("Label,extra,Flow Bytes/s,Flow ID\nDoS,x,1.5,10\nLabel,extra,Flow Bytes/s,Flow ID\n")
    (tmp_path / "d" / "deep" / "two.csv").write_text("Flow ID,Flow Bytes/s,Label\n11,2.5,BENIGN\n")
    got = flows.read_datasets(spark, str(tmp_path), SCHEMA, NAMES)
    rows = {r.record_id: (r.rate, r["class"], r.dataset, r[flows.CORRUPT]) for r in got.collect()}
    assert rows.pop(10) == (1.5, "DoS", "d", None) and rows.pop(11) == (2.5, "BENIGN", "d", None)
    assert rows[None][3] == "Label,extra,Flow Bytes/s,Flow ID"
    (tmp_path / "d" / "short.csv").write_text("Flow ID,Label\n1,x\n")
    with pytest.raises(ValueError, match="Flow Bytes/s"):
        flows.read_datasets(spark, str(tmp_path), SCHEMA, NAMES)


def test_manifest_and_tampering(spark, root):
    path = str(root)
    first = manifest.build_manifest(spark, path, "*.csv")
    recorded = spark.createDataFrame(first.collect(), first.schema)
    for r in recorded.collect():
        folder = "set one" if "set%20one" in r.file else "set+two"
        data = (root / folder / "part a.csv").read_bytes()
        assert (r.sha256, r.length) == (hashlib.sha256(data).hexdigest(), len(data))
    target = root / "set one" / "part a.csv"
    target.write_text(target.read_text() + "9,1,DoS\n")
    (root / "set one" / "late.csv").write_text("Flow ID,Flow Bytes/s,Label\n10,1,DoS\n")
    gone = spark.createDataFrame([("file:///gone.csv", 1, "00")], recorded.schema)
    status = verify_integrity(recorded.unionByName(gone), manifest.build_manifest(spark, path, "*.csv"))
    by_name = {r.file.rsplit("/", 2)[-2] + "/" + r.file.rsplit("/", 1)[-1]: r.status for r in status.collect()}
    assert by_name == {
        "set%20one/part%20a.csv": "mismatch", "set%20one/late.csv": "unlisted",
        "set+two/part%20a.csv": "verified", "/gone.csv": "missing",
    }
    records = flows.read_datasets(spark, path, SCHEMA, NAMES)
    out = attach_integrity(records, status).withColumn("i", integrity_factor())
    assert {r.record_id: r.i for r in out.collect()} == {1: 0.0, 2: 0.0, 3: 0.0, 9: 0.0, 10: 0.5, 4: 1.0, 5: 1.0}


def test_digest_of_a_file_longer_than_a_chunk(tmp_path):
    data = bytes(range(256)) * 10_000
    (tmp_path / "big.bin").write_bytes(data)
    assert manifest.sha256_of(str(tmp_path / "big.bin")) == hashlib.sha256(data).hexdigest()


def test_clean_keeps_the_lowest_key_of_copies(spark):
    rows = [(3, "a", "1.5"), (1, "a", "1.5"), (2, "b", "NaN"), (4, "c", "x"), (5, None, "2"), (None, "d", "3")]
    df = spark.createDataFrame(rows, "id long, text string, v string")
    out = clean(df, "id", {"v": "double"}, ["text", "v"], required=["text"])
    assert [tuple(r) for r in out.orderBy("id").collect()] == [(1, "a", 1.5)]
    no_numbers = clean(df, "id", {}, ["text"])
    assert sorted(r.id for r in no_numbers.collect()) == [1, 2, 4, 5]


def test_harmonize_fills_and_maps(spark):
    a = spark.createDataFrame([(1, "DoS", 1.0), (2, "odd", 2.0)], "id long, l string, x double")
    b = spark.createDataFrame([("k", "ok", 3.0)], "key string, tag string, z double")
    out = harmonize(
        {
            "a": (a, FlowMapping(F.col("id"), F.col("l"), {"x": F.col("x")})),
            "b": (b, FlowMapping(F.col("key"), F.col("tag"), {"z": F.col("z")})),
        },
        {"a": {"DoS": "dos"}, "b": {"ok": "benign"}},
    )
    rows = {r.record_id: (r.dataset, r["class"], r.y, r.x, r.z) for r in out.collect()}
    assert rows == {"1": ("a", "dos", 1, 1.0, None), "2": ("a", None, None, 2.0, None), "k": ("b", "benign", 0, None, 3.0)}


def test_repeated_record_key_is_refused(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (1, "c")], "id long, v string")
    assert require_unique(df.where("v <> 'c'"), "id").count() == 2
    with pytest.raises(ValueError, match="id 1 occurs 2 times"):
        require_unique(df, "id")


def test_run_log_appends(spark, tmp_path):
    log = spark.sql("select 'r1' run_id, 'fit' stage, 10L rows, 1.5D seconds, timestamp'2024-01-01' started")
    for _ in range(2):
        sinks.append_run_log(log, str(tmp_path / "log"))
    assert spark.read.parquet(str(tmp_path / "log")).count() == 2


def separable(spark):
    return spark.range(400).select(
        (F.col("id") % 2).cast("int").alias("y"),
        (F.col("id") % 2 * 4 + (F.col("id") % 7) / 7).alias("x1"),
        F.when(F.col("id") % 11 > 0, (F.col("id") % 5).cast("double")).alias("x2"),
    )


@pytest.mark.parametrize("name", sorted(ESTIMATORS))
def test_baselines_learn_a_separable_set(spark, name):
    df = separable(spark)
    out = score_baseline(df, fit_baseline(df, ["x1", "x2"], name), ["y"]).toPandas()
    assert (out.pred == out.y).all()
    assert ((out.s > 0.5) == (out.y == 1)).all()


def test_saved_model_scores_alike(spark, tmp_path):
    df = separable(spark)
    model = fit_baseline(df, ["x1", "x2"], "logistic_regression")
    sinks.save_model(model, str(tmp_path / "model"))
    again = sinks.load_model(str(tmp_path / "model"))
    left, right = (score_baseline(df, m, ["y"]).orderBy("s").collect() for m in (model, again))
    assert left == right


def test_tuning_picks_the_better_grid_point(spark):
    df = separable(spark)
    tried = tune_baseline(df, df, ["x2", "x1"], "decision_tree", [{"maxDepth": 0}, {"maxDepth": 3}, {"maxDepth": 4}])
    rows = {r.params: (r.auc, r.chosen) for r in tried.collect()}
    assert rows == {"maxDepth=0": (0.5, False), "maxDepth=3": (1.0, True), "maxDepth=4": (1.0, False)}


def test_blocks_say_where_a_file_was_altered(spark, tmp_path):
    from plumbline.operators.integrity import altered_blocks

    files = {"a.bin": bytes(range(256)) * 20, "b.bin": b"x" * 1000, "c.bin": b"z" * 700, "d.bin": b"y" * 2048}
    first, second = tmp_path / "first", tmp_path / "second"
    for folder in (first, second):
        folder.mkdir()
        for name, data in files.items():
            (folder / name).write_bytes(data)
    changed = bytearray(files["a.bin"])
    changed[3000] ^= 1  # block 5 of 512 bytes
    (second / "a.bin").write_bytes(changed)
    (second / "c.bin").write_bytes(b"")  # gone: Spark lists no empty files
    (second / "b.bin").write_bytes(files["b.bin"] + b"x" * 100)  # the last block grows, one more begins
    name = F.regexp_extract("file", r"([^/]+)$", 1)
    then, now = (manifest.block_digests(spark, str(f), "*.bin", 512).withColumn("file", name) for f in (first, second))
    assert {(r.file, r.part) for r in altered_blocks(then, now).collect()} == {
        ("a.bin", 5), ("b.bin", 1), ("b.bin", 2), ("c.bin", 0), ("c.bin", 1)
    }
    roots = [{r.file: r.sha256 for r in manifest.merkle_roots(x, 3).collect()} for x in (then, now)]
    assert {n for n in files if roots[0][n] != roots[1].get(n)} == {"a.bin", "b.bin", "c.bin"}

    def root(data):
        level = [hashlib.sha256(data[i : i + 512]).hexdigest() for i in range(0, max(len(data), 1), 512)]
        while len(level) > 1:
            level = [hashlib.sha256("".join(level[i : i + 3]).encode()).hexdigest() for i in range(0, len(level), 3)]
        return level[0]

    assert roots[0] == {n: root(data) for n, data in files.items()}


def test_bucketed_tables_join_without_a_shuffle(spark, tmp_path):
    ids = spark.range(500).select(F.concat(F.lit("r"), "id").alias("record_id"), F.col("id").alias("x"))
    a = sinks.write_bucketed(ids, str(tmp_path / "a"), "record_id", 4)
    b = sinks.write_bucketed(ids.where("x % 2 = 0").withColumn("z", F.col("x") * 2).drop("x"), str(tmp_path / "b"), "record_id", 4)
    both = a.join(b.hint("merge"), "record_id")
    plan = both._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "SortMergeJoin" in plan
    assert both.count() == 250 and both.where("z <> 2 * x").count() == 0


def test_a_log_of_stages_that_ran(spark, tmp_path):
    from plumbline.operators.measured import Measured

    run, path = Measured(spark, "r1"), str(tmp_path / "log")
    run.save(path)  # nothing ran
    wide = spark.range(1000).repartition(3).select("id", (F.col("id") % 2).alias("part"))
    assert run.stage(wide, "wide", ("part",)).count() == 1000
    run.stage(wide.where("id < 0"), "empty")
    with pytest.raises(Exception):
        run.stage(wide.select(F.raise_error(F.lit("no"))), "failing")
    run.save(path)
    run.save(path)
    run.stage(wide.where("id < 10"), "wide")
    run.save(path)
    rows = [(r.run_id, r.stage, r.rows) for r in spark.read.parquet(path).orderBy("started").collect()]
    assert rows == [("r1", "wide", 1000), ("r1", "empty", 0), ("r1", "wide", 10)]
    assert spark.read.parquet(path).where("seconds > 0 and started is not null").count() == 3
