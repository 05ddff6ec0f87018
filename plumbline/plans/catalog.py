"""Registered queries: one per operator, over whole tables."""

from __future__ import annotations

import json
import threading
from collections.abc import Callable
from contextlib import contextmanager
from functools import partial, reduce

from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions.scalars import hash_bucket, micros, with_scalar
from plumbline.operators import consolidate as C
from plumbline.operators import evaluate as E
from plumbline.operators import experiments as X
from plumbline.operators import store as S
from plumbline.operators import auctest, calibrate, fusion, groups, inference, integrity, logistic, prepare, reasoning, scoring, splits, stats, trees
from plumbline.operators.baseline import ESTIMATORS, fit_baseline, fit_preparation, score_baselines, tune_baseline
from plumbline.operators.describe import assess, class_distribution, describe_features, merged_assessment, part_sketches, store_sketches
from plumbline.operators.measured import Measured
from plumbline.operators.reliability import ALPHA, reliability, simplex_grid
from plumbline.operators.views import melt_views, to_views, with_quality
from plumbline.plans import bindings as B
from plumbline.plans.bindings import DOCUMENT_VIEWS, EVENT_CLASSES, EVENT_VIEWS, LINE_DATASETS, LINE_VIEWS
from plumbline.session import fresh_path, side_by_side, stage
from plumbline.sources import flows, manifest, sinks
from plumbline.spec import FlowMapping

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

CV_REPEATS, CV_FOLDS = 3, 5
PERMUTATIONS = 500
ALPHA_GRID = simplex_grid(("a_i", "a_q", "a_t"))


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


_full = threading.local()


@contextmanager
def full_precision():
    """Results are stored as they are; only what is shown is rounded."""
    before, _full.on = getattr(_full, "on", False), True
    try:
        yield
    finally:
        _full.on = before


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles at ``digits`` places, so that two engines' sums compare equal."""
    if getattr(_full, "on", False):
        return df
    doubles = [n for n, t in df.dtypes if t == "double"]
    return df.withColumns({n: F.round(n, digits) + F.lit(0.0) for n in doubles})


# ---- fusion -----------------------------------------------------------------


def fused_events(evidence: DataFrame, params: DataFrame, weights: DataFrame, alpha: DataFrame) -> DataFrame:
    scored = with_scalar(scoring.score_views(evidence, EVENT_VIEWS, params), weights, "_G")
    scored = with_scalar(scored, alpha, "_A")
    out = fusion.fuse(
        scored, EVENT_VIEWS, fusion.weight_columns(EVENT_VIEWS, "_G"), fusion.alpha_columns("_A")
    )
    return out.withColumn("s_unweighted", fusion.unweighted(EVENT_VIEWS))


@query
def reliability_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship: fit on train, weigh on validation, fuse every record."""
    evidence = B.event_evidence(spark, sf_dir)
    params = scoring.fit_view_params(B.split_rows(evidence, "train"), EVENT_VIEWS)
    val = scoring.score_views(B.split_rows(evidence, "validation"), EVENT_VIEWS, params)
    weights = stage(fusion.fit_view_weights(val, EVENT_VIEWS), "flagship_weights")
    alpha = fusion.fit_alpha(with_scalar(val, weights, "_G"), EVENT_VIEWS, ALPHA_GRID)
    out = fused_events(evidence, params, weights, alpha)
    return rounded(out.select("record_id", "split", "y", "s", "s_unweighted"))


@query
def unweighted_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = B.event_scores(spark, sf_dir)
    return rounded(scored.select("record_id", fusion.unweighted(EVENT_VIEWS).alias("s_unweighted")))


@query
def view_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    val = B.split_rows(B.event_scores(spark, sf_dir), "validation")
    return rounded(fusion.weights_long(fusion.fit_view_weights(val, EVENT_VIEWS), EVENT_VIEWS))


@query
def view_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probability and decision per record and view; thresholds from validation."""
    scored = B.event_scores(spark, sf_dir)
    long = lambda df: melt_views(df, EVENT_VIEWS, ["record_id", "split", "y"], score="p_")
    theta = E.fit_threshold(
        long(B.split_rows(scored, "validation")), by=["view"], score="score"
    )
    out = X.with_fitted(long(scored), theta, ["view"], ["theta"])
    pred = (F.col("score") >= F.col("theta")).cast("double")
    return rounded(out.select("record_id", "view", "score", pred.alias("pred")))


@query
def view_parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    train = B.split_rows(B.line_evidence(spark, sf_dir), "train")
    long = scoring.params_long(scoring.fit_view_params(train, LINE_VIEWS), LINE_VIEWS)
    return rounded(long.select("view", "feature", "class", "mean", F.sqrt("var").alias("sd"), "n"), 4)


@query
def integrity_factor(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = B.documents(spark, sf_dir).select("record_id", "file")
    side = stage(B.document_manifest(spark, sf_dir), "manifest")
    out = integrity.attach_integrity(d, side)
    return out.select("record_id", "status", integrity.integrity_factor().alias("i"))


@query
def quality_factor(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = with_quality(B.documents(spark, sf_dir), DOCUMENT_VIEWS)
    return rounded(melt_views(d, DOCUMENT_VIEWS, ["record_id"], q="q_"))


@query
def temporal_factor(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = B.event_evidence_plan(spark, sf_dir)
    return rounded(e.select("record_id", "entity", "gap", "t"))


@query
def temporal_order_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = B.line_evidence_plan(spark, sf_dir)
    return rounded(e.select("record_id", "lag_days", "t"), 12)


@query
def reliability_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = B.line_evidence(spark, sf_dir).withColumns(reliability(LINE_VIEWS, ALPHA))
    # Times of a power of two days end in a 5: more places than any of them has.
    return rounded(melt_views(e, LINE_VIEWS, ["record_id", "i", "t"], q="q_", r="r_"), 12)


def fitted_alpha(spark: SparkSession, sf_dir: str) -> DataFrame:
    val = B.split_rows(B.line_scores(spark, sf_dir), "validation")
    val = with_scalar(val, B.line_weights(spark, sf_dir), "_G")
    return fusion.fit_alpha(val, LINE_VIEWS, ALPHA_GRID)


@query
def reliability_coefficients(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(fitted_alpha(spark, sf_dir))


def line_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with verdict and confidence parts, from fitted coefficients and threshold."""
    rows = with_scalar(line_fused(spark, sf_dir), line_theta(spark, sf_dir), "_T")
    out = reasoning.reason(rows, LINE_VIEWS, F.col("_T.theta"))
    return reasoning.confidence_parts(
        out, LINE_VIEWS, fusion.weight_columns(LINE_VIEWS, "_G"), F.col("_T.theta")
    )


def variant_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    def fitted() -> DataFrame:
        rows = B.split_rows(line_fused(spark, sf_dir), "validation")
        return X.variant_thresholds(rows, X.standard_variants(LINE_VIEWS))

    return B.once(spark, sf_dir, "line_variant_thetas", fitted)


@query
def decision_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Threshold of every view and both fusions, chosen on validation rows."""
    return rounded(variant_thresholds(spark, sf_dir))


@query
def forensic_reasoning(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_cases(spark, sf_dir).select(
        "record_id",
        "s",
        "verdict",
        F.array_join("supporting", ",").alias("supporting"),
        F.array_join("contradicting", ",").alias("contradicting"),
        F.try_element_at("contributions", F.lit(1))["view"].alias("top_view"),
        # Shares scale with weights that are small differences of means, so the
        # engines agree on fewer digits of them than of the score.
        *[F.round(f"share_{v}", 4).alias(f"share_{v}") for v in LINE_VIEWS.names],
    )
    return rounded(out)


def line_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cases with their confidence, from coefficients fitted on validation rows."""
    rows = line_cases(spark, sf_dir)
    beta = B.once(
        spark,
        sf_dir,
        "line_beta",
        lambda: reasoning.fit_beta(
            B.split_rows(rows, "validation"), simplex_grid(("b_r", "b_a", "b_m"))
        ),
    )
    out = with_scalar(rows, beta, "_B")
    value = reasoning.confidence(tuple(F.col(f"_B.{n}") for n in ("b_r", "b_a", "b_m")))
    return out.withColumn("confidence", value)


@query
def investigation_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_confidence(spark, sf_dir)
    return rounded(out.select("record_id", "verdict", "c_r", "c_a", "c_m", "confidence"))


def line_calibrated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Confidence as a share of correct verdicts, fitted on validation rows."""
    def cases() -> DataFrame:
        correct = reasoning.verdict_correct().cast("int").alias("correct")
        return line_confidence(spark, sf_dir).select("record_id", "split", "confidence", correct)

    rows = B.once(spark, sf_dir, "line_confidence", cases, partition_by=("split",))
    fitted = lambda: calibrate.fit_isotonic(B.split_rows(rows, "validation"), "confidence", "correct")
    return calibrate.calibrate(rows, "confidence", B.once(spark, sf_dir, "line_isotonic", fitted))


@query
def calibrated_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(line_calibrated(spark, sf_dir).select("record_id", "split", "confidence", "calibrated"))


@query
def calibration_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calibration error and Brier score per split, before and after calibration."""
    rows = line_calibrated(spark, sf_dir)
    return rounded(calibrate.calibration_error(rows, ["confidence", "calibrated"], "correct", ["split"]))


# ---- preparation ------------------------------------------------------------


@query
def clean_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = B.load(spark, sf_dir, "documents")
    out = prepare.clean(d, "doc_id", {"n_chars": "double"}, ["text", "lang", "source", "n_chars"], required=["text"])
    return out.select("doc_id", "lang", "source", "n_chars", F.md5("text").alias("digest"))


EVENT_CLASS_MAP = {c: ("fault" if c == "error" else "benign") for c in EVENT_CLASSES}
LINE_CLASS_MAP = {"R": "returned", "A": "benign"}


@query
def harmonized_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two tables in one schema; the class N of lines is not mapped and stays null."""
    events = FlowMapping(
        record_id=F.col("event_id"),
        cls=F.col("event_type"),
        entity=F.col("user_id"),
        ts=F.col("ts"),
        features={"amount": F.col("value"), "k": F.get_json_object("props", "$.k").try_cast("double")},
    )
    lines = FlowMapping(
        record_id=B.line_key(),
        cls=F.col("l_returnflag"),
        entity=F.col("l_orderkey"),
        ts=F.col("l_shipdate"),
        features={"amount": F.col("l_extendedprice"), "discount": F.col("l_discount")},
    )
    return prepare.harmonize(
        {
            "events": (B.load(spark, sf_dir, "events"), events),
            "lines": (B.load(spark, sf_dir, "lineitem"), lines),
        },
        {"events": EVENT_CLASS_MAP, "lines": LINE_CLASS_MAP},
    ).drop("file").withColumn("y", F.col("y").cast("double"))


@query
def transformed_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = B.line_evidence(spark, sf_dir)
    params = prepare.fit_scaler(B.split_rows(e, "train"), LINE_VIEWS.features)
    how = {
        "l_quantity": "minmax",
        "l_extendedprice": "log1p",
        "l_discount": "zscore",
        "l_tax": "clip",
        "lag_days": "log1p",
    }
    return rounded(prepare.transform_features(e, how, params).select("record_id", "split", *how))


@query
def scaled_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = B.event_evidence(spark, sf_dir)
    params = prepare.fit_scaler(B.split_rows(e, "train"), EVENT_VIEWS.features)
    out = prepare.apply_scaler(e, params, EVENT_VIEWS.features)
    return rounded(out.select("record_id", "split", *EVENT_VIEWS.features))


@query
def evidence_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = B.event_evidence(spark, sf_dir)
    return rounded(to_views(e, EVENT_VIEWS, ["record_id", "split", "y"]))


@query
def split_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.event_records(spark, sf_dir).select("record_id", "class", "split")


@query
def stratified_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.stratified_split(B.event_records(spark, sf_dir), "record_id", "class")


@query
def fold_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.assign_folds(
        B.event_records(spark, sf_dir), "record_id", "class", CV_FOLDS, CV_REPEATS
    )


@query
def group_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events of a user in one part."""
    records = B.event_records(spark, sf_dir)
    parts = groups.group_split(records, "record_id", "entity", "class")
    return records.select("record_id", "entity", "class").join(parts, "record_id")


@query
def group_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups.group_folds(
        B.event_records(spark, sf_dir), "record_id", "entity", "class", CV_FOLDS, CV_REPEATS
    )


@query
def seeded_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = B.load(spark, sf_dir, "events")
    return e.select(
        "event_id",
        hash_bucket(42, "event_id").alias("bucket_a"),
        hash_bucket(7, "event_id").alias("bucket_b"),
    )


# ---- description ------------------------------------------------------------


@query
def dataset_assessment(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = B.documents(spark, sf_dir).drop("file")
    return assess(d, ["text", "n_chars", "n_words", "y", "toxic"], "dataset", "record_id")


@query
def assessment_by_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The assessment from stored sketches of each source file, some of which arrive twice; the
    estimates of distinct values are held against the exact ones (five standard errors)."""
    cols, path = ["text", "n_chars", "n_words", "y", "toxic"], fresh_path(spark, "part_sketches")
    d = B.documents(spark, sf_dir)
    sketches = stage(part_sketches(d, cols, "dataset", "record_id", "file"), "new_sketches")
    store_sketches(sketches, path)
    store_sketches(sketches.where("pmod(xxhash64(part), 3) = 0"), path)
    merged = merged_assessment(spark.read.schema(sketches.schema).parquet(path), "dataset").alias("m")
    exact = assess(d.drop("file"), cols, "dataset", "record_id").alias("e")
    same = F.col("m.dataset").eqNullSafe(F.col("e.dataset")) & (F.col("m.column") == F.col("e.column"))
    near = F.abs(F.col("m.distinct") - F.col("e.distinct")) <= 0.04 * F.col("e.distinct")
    return merged.join(exact, same).select(
        "m.dataset", "m.column", "m.rows", "m.nulls", "m.non_finite", near.alias("distinct_within")
    )


@query
def feature_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = B.line_evidence(spark, sf_dir)
    return rounded(describe_features(rows, LINE_VIEWS.features, "dataset"), 4)


@query
def class_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(class_distribution(B.line_evidence(spark, sf_dir)))


# ---- sources and sinks ------------------------------------------------------

EVENT_CSV = T.StructType(
    [
        T.StructField("event_id", T.LongType()),
        T.StructField("user_id", T.LongType()),
        T.StructField("event_type", T.StringType()),
        T.StructField("value", T.DoubleType()),
        T.StructField("props", T.StringType()),
        T.StructField("ts_us", T.LongType()),
    ]
)


@query
def csv_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table written as flow CSV, then scanned with a declared schema."""
    path = fresh_path(spark, "events_csv")
    names = EVENT_CSV.fieldNames()
    events = B.load(spark, sf_dir, "events").withColumn("ts_us", micros("ts"))
    events.select(*names).write.options(
        header=True, escape='"'
    ).csv(path)
    out = flows.read_flows(spark, path, EVENT_CSV, {"event_id": "record_id"})
    return out.drop("file", flows.CORRUPT)


@query
def csv_datasets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines written to one directory per line status, then found and tagged."""
    root = fresh_path(spark, "line_datasets")
    lines = B.load(spark, sf_dir, "lineitem")
    names = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice", "l_quantity"]
    tagged = lines.select(*names, F.col("l_linestatus").alias("status"))
    tagged.write.partitionBy("status").option("header", True).csv(root)
    schema = T.StructType([f for f in lines.schema.fields if f.name in names])
    ordered = T.StructType([schema[n] for n in names])
    found = flows.read_datasets(spark, root, ordered)
    dataset = F.regexp_extract("dataset", "^status=(.*)$", 1).alias("dataset")
    return found.select(B.line_key().alias("record_id"), dataset, "l_extendedprice", "l_quantity")


@query
def source_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SHA-256 of the supplied parquet files themselves."""
    return manifest.build_manifest(spark, sf_dir, "*.parquet").withColumn(
        "file", F.regexp_extract("file", r"([^/]+)$", 1)
    )


CUSTOMER_CSV = T.StructType(
    [T.StructField("c_custkey", T.LongType()), T.StructField("c_nationkey", T.IntegerType()), T.StructField("c_mktsegment", T.StringType())]
)


def customer_files(spark: SparkSession, sf_dir: str, altered: bool) -> str:
    """Customers in CSV files of 100 keys each, as acquired or with a record of every fifth file altered."""
    path = fresh_path(spark, "customer_files")
    rows = B.load(spark, sf_dir, "customer").select(*CUSTOMER_CSV.fieldNames())
    rows = rows.withColumn("block", F.floor(F.col("c_custkey") / 100))
    if altered:
        hit = (F.col("block") % 5 == 1) & (F.col("c_custkey") % 100 == 50)
        rows = rows.withColumn("c_mktsegment", F.when(hit, F.lit("ALTERED")).otherwise(F.col("c_mktsegment")))
    ordered = rows.repartition("block").sortWithinPartitions("block", "c_custkey")
    ordered.write.partitionBy("block").options(header=True).csv(path)
    return path


@query
def file_integrity_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files, manifest, records, comparison of digests, and the factor of each record: S3, S1, S5, S4, F1.

    Digests are recorded when the files are acquired, but not for every seventh file; later
    some files are altered, and the records are read from what is there then.
    """
    block = F.regexp_extract("file", r"block=(-?[0-9]+)", 1).cast("long")
    later = customer_files(spark, sf_dir, altered=True)
    acquired = manifest.build_manifest(spark, customer_files(spark, sf_dir, altered=False), "*.csv")
    recorded = acquired.withColumn("file", block).where("file % 7 <> 3")
    present = manifest.build_manifest(spark, later, "*.csv").withColumn("file", block)
    status = stage(integrity.verify_integrity(recorded, present), "file_status")
    records = flows.read_flows(spark, later, CUSTOMER_CSV, {"c_custkey": "record_id"}, deep=True)
    out = integrity.attach_integrity(records.drop(flows.CORRUPT).withColumn("file", block), status)
    return out.select(
        "record_id", "file", "c_mktsegment", "recorded", "recomputed", "status", integrity.integrity_factor().alias("i")
    )


FILE_BLOCK, FILE_FANOUT = 512, 4


@query
def file_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Root of each file's hash tree as acquired and now, and which of its blocks differ."""
    number = F.regexp_extract("file", r"block=(-?[0-9]+)", 1).cast("long")
    then, now = (
        stage(
            manifest.block_digests(spark, customer_files(spark, sf_dir, altered), "*.csv", FILE_BLOCK).withColumn("file", number),
            "file_blocks",
        )
        for altered in (False, True)
    )
    root = lambda blocks, name: manifest.merkle_roots(blocks, FILE_FANOUT).select("file", F.col("sha256").alias(name))
    changed = integrity.altered_blocks(then, now).groupBy("file").agg(
        F.count("*").alias("n_altered"), F.min("part").alias("first_altered")
    )
    out = root(then, "recorded").join(root(now, "recomputed"), "file", "full_outer").join(changed, "file", "left")
    return out.select("file", "recorded", "recomputed", F.coalesce("n_altered", F.lit(0)).alias("n_altered"), "first_altered")


@query
def attached_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = B.documents(spark, sf_dir).select("record_id", "file")
    return integrity.attach_integrity(d, stage(B.document_manifest(spark, sf_dir), "manifest"))


@query
def verified_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return integrity.verify_integrity(*B.document_digests(spark, sf_dir))


@query
def written_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "splits")
    sinks.write_splits(B.line_evidence(spark, sf_dir).select("record_id", "dataset", "split"), path)
    return spark.read.parquet(path).groupBy("split", "dataset").agg(
        F.count("*").alias("n"), F.min("record_id").alias("first_id"), F.max("record_id").alias("last_id")
    )


@query
def written_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "predictions")
    long = melt_views(B.line_scores(spark, sf_dir), LINE_VIEWS, ["record_id", "dataset"], score="p_")
    sinks.write_predictions(long, path)
    schema = T.StructType([long.schema[c] for c in ("record_id", "score", "dataset", "view")])
    return rounded(spark.read.schema(schema).parquet(path))


@query
def bucketed_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Splits and scores in tables bucketed by record, joined without a shuffle."""
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    scores = B.line_scores(spark, sf_dir)
    parts = {
        "splits": scores.select("record_id", "dataset", "split"),
        "scores": scores.select("record_id", *[f"p_{v}" for v in LINE_VIEWS.names]),
    }
    tables = {n: sinks.write_bucketed(df, fresh_path(spark, n), "record_id", buckets) for n, df in parts.items()}
    return rounded(tables["splits"].join(tables["scores"].hint("merge"), "record_id"))


@query
def saved_parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fitted parameters saved, reloaded, and used to score every record."""
    path = fresh_path(spark, "view_params")
    train = B.split_rows(B.event_evidence(spark, sf_dir), "train")
    sinks.save_params(
        scoring.params_long(scoring.fit_view_params(train, EVENT_VIEWS), EVENT_VIEWS), path
    )
    params = scoring.params_wide(sinks.load_params(spark, path), EVENT_VIEWS)
    scored = scoring.score_views(B.event_evidence(spark, sf_dir), EVENT_VIEWS, params)
    return rounded(scored.select("record_id", *[f"p_{v}" for v in EVENT_VIEWS.names]))


@query
def appended_run_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log arrives in batches; each append adds files to the same table."""
    path = fresh_path(spark, "run_log")
    log = B.run_log(spark, sf_dir)
    batch = F.pmod(F.xxhash64("run_id"), F.lit(2))
    for j in range(2):
        sinks.append_run_log(log.where(batch == j), path)
    return spark.read.parquet(path).select(
        "run_id", "stage", "rows", "seconds", micros("started").alias("started_us")
    )


# ---- evaluation -------------------------------------------------------------


def line_fitted(spark: SparkSession, sf_dir: str, rows: DataFrame) -> DataFrame:
    """``rows`` with the fitted weights ``_G`` and coefficients ``_A``."""
    alpha = B.once(spark, sf_dir, "line_alpha", lambda: fitted_alpha(spark, sf_dir))
    return with_scalar(with_scalar(rows, B.line_weights(spark, sf_dir), "_G"), alpha, "_A")


def line_fused(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = line_fitted(spark, sf_dir, B.line_scores(spark, sf_dir))
    return fusion.fuse(
        scored, LINE_VIEWS, fusion.weight_columns(LINE_VIEWS, "_G"), fusion.alpha_columns("_A")
    )


def line_theta(spark: SparkSession, sf_dir: str) -> DataFrame:
    fitted = lambda: E.fit_threshold(B.split_rows(line_fused(spark, sf_dir), "validation"))
    return B.once(spark, sf_dir, "line_theta", fitted)


@query
def confusion_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = line_fused(spark, sf_dir)
    rows = with_scalar(B.split_rows(rows, "test"), line_theta(spark, sf_dir), "_T")
    pred = rows.withColumn("pred", F.coalesce(F.col("s") >= F.col("_T.theta"), F.lit(False)).cast("int"))
    return rounded(E.rates(E.confusion(pred, by=["dataset"])))


@query
def ranking_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = line_fused(spark, sf_dir)
    long = X.score_variants(rows, X.standard_variants(LINE_VIEWS), ["split", "y"])
    return rounded(E.auc(long, ["variant", "split"]))


@query
def class_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = B.event_evidence(spark, sf_dir)
    features = EVENT_VIEWS.features
    params = scoring.fit_class_params(B.split_rows(e, "train"), features, EVENT_CLASSES, "class")
    test = scoring.predict_class(B.split_rows(e, "test"), features, EVENT_CLASSES, params)
    return rounded(E.per_class(test, "class", "yhat"))


@query
def view_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = line_fused(spark, sf_dir)
    return rounded(
        X.validate_views(B.split_rows(rows, "validation"), B.split_rows(rows, "test"), LINE_VIEWS)
    )


@query
def component_ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = line_fitted(spark, sf_dir, B.line_scores(spark, sf_dir))
    return rounded(
        X.ablate(
            B.split_rows(rows, "validation"),
            B.split_rows(rows, "test"),
            LINE_VIEWS,
            fusion.weight_columns(LINE_VIEWS, "_G"),
            fusion.alpha_columns("_A"),
        )
    )


@query
def degraded_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The amount view dropped for 30 % of the records, the timing view perturbed for half."""
    e = B.event_evidence(spark, sf_dir)
    out = X.degrade(e, EVENT_VIEWS, F.lit("amount"), F.lit(0.3), 42)
    out = X.degrade(
        out, EVENT_VIEWS, F.lit("timing"), F.lit(0.5), 42, mode="noise", scale={f: F.lit(60.0) for f in EVENT_VIEWS.features}
    )
    return rounded(with_quality(out, EVENT_VIEWS).select("record_id", *EVENT_VIEWS.features, "q_amount"))


def line_degradation(spark: SparkSession, sf_dir: str, **how) -> DataFrame:
    models = with_scalar(scoring.score_constants(B.line_params(spark, sf_dir), LINE_VIEWS), line_logistic(spark, sf_dir), "_L")
    rows = with_scalar(B.line_evidence(spark, sf_dir), models, "_P")
    baselines = {
        "baseline:gaussian": X.gaussian_baseline(LINE_VIEWS),
        "baseline:logistic": logistic.probability(LINE_VIEWS.features, "_P._L"),
    }
    clean = B.split_rows(rows, "validation")
    fitted = lambda: X.variant_thresholds(clean, baselines)
    theta = variant_thresholds(spark, sf_dir).unionByName(B.once(spark, sf_dir, "line_baseline_thetas", fitted))
    rows = line_fitted(spark, sf_dir, B.split_rows(rows, "test"))
    return rounded(
        X.degradation_curve(
            rows,
            LINE_VIEWS,
            fusion.weight_columns(LINE_VIEWS, "_G"),
            fusion.alpha_columns("_A"),
            stage(theta, "degradation_thetas"),
            42,
            baselines=baselines,
            **how,
        )
    )


@query
def degradation_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both fusions and two conventional models while a view's evidence is dropped."""
    return line_degradation(spark, sf_dir)


# Half width of the uniform noise of each feature.
LINE_NOISE = {"l_quantity": 25.0, "l_extendedprice": 40000.0, "l_discount": 0.05, "l_tax": 0.04, "lag_days": 60.0}


@query
def degradation_noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same models while a view's evidence is perturbed."""
    return line_degradation(spark, sf_dir, mode="noise", scale={f: F.lit(x) for f, x in LINE_NOISE.items()})


@query
def cross_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(X.cross_dataset(B.line_evidence(spark, sf_dir), LINE_VIEWS, ALPHA_GRID))


def event_cv(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = B.event_evidence(spark, sf_dir)
    folds = splits.assign_folds(e, "record_id", "class", CV_FOLDS, CV_REPEATS)
    return X.cv_scores(e.drop("class"), folds, EVENT_VIEWS, CV_FOLDS, ALPHA_GRID)


@query
def cv_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(event_cv(spark, sf_dir))


# ---- statistics -------------------------------------------------------------


def stored_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.once(spark, sf_dir, "cv_scores", lambda: event_cv(spark, sf_dir))


COMPARED = ("unweighted", "baseline:gaussian", "baseline:logistic")


def stored_diffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reliability fusion against the plain mean and against conventional models."""
    scores, out = stored_scores(spark, sf_dir), None
    for other in COMPARED:
        part = stats.paired(scores, "reliability", other, ["metric"]).withColumn("versus", F.lit(other))
        out = part if out is None else out.unionByName(part)
    return out


@query
def score_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(stats.summarize_scores(stored_scores(spark, sf_dir), ["model", "metric"]))


@query
def paired_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(stored_diffs(spark, sf_dir))


@query
def paired_t_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(stats.paired_t(stored_diffs(spark, sf_dir), ["versus", "metric"]), 5)


@query
def signed_rank_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(stats.signed_rank(stored_diffs(spark, sf_dir), ["versus", "metric"]))


@query
def permutation_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(stats.permutation_p(stored_diffs(spark, sf_dir), ["versus", "metric"], PERMUTATIONS))


@query
def efficiency_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(stats.efficiency(B.run_log(spark, sf_dir)), 4)


@query
def scalability_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(stats.scalability(B.run_log(spark, sf_dir)), 9)


@query
def measured_stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Preparation and scoring of all lines, logged while they run (S9), and read as C1 and C2.

    Scores are computed split by split, which gives three sizes. Seconds differ from run to run;
    ``timed`` says that they yield a rate in both tables.
    """
    run, path = Measured(spark, "lines"), fresh_path(spark, "measured_log")
    records = run.stage(B.line_records(spark, sf_dir), "records")
    evidence = run.stage(B.line_evidence_of(records), "evidence", ("split",))
    prepare.require_unique(evidence, "record_id")
    params = stage(scoring.fit_view_params(B.split_rows(evidence, "train"), LINE_VIEWS), "measured_params")
    scored = scoring.score_views(evidence, LINE_VIEWS, params)
    for part in ("train", "validation", "test"):
        run.stage(B.split_rows(scored, part), "scores")
    run.save(path)
    log = spark.read.parquet(path)
    total = stats.efficiency(log).alias("a")
    sizes = stats.scalability(log).alias("b")
    timed = (F.col("a.rows_per_second") > 0) & (F.col("b.rows_per_second") > 0) & (F.col("a.median_seconds") > 0)
    return sizes.join(total, "stage").select(
        "stage", "b.rows", "b.runs", F.col("a.runs").alias("stage_runs"), F.col("a.total_rows").alias("stage_rows"), timed.alias("timed")
    )


# ---- consolidation ----------------------------------------------------------


RATE_METRICS = ["accuracy", "auc", "brier", "f1"]


def experiment_outputs() -> list[tuple]:
    """Query, experiment, output, dataset, subject and numbers of everything that is stored."""
    lines, events = F.lit("lines"), F.lit("events")
    joined = lambda *c: F.concat_ws(":", *c)
    return [
        (dataset_assessment, 1, "dataset_assessment", F.col("dataset"), F.col("column"), ["rows", "nulls", "distinct"]),
        (feature_statistics, 1, "descriptive_statistics", F.col("dataset"), F.col("feature"), ["mean", "sd", "p50"]),
        (baseline_gaussian, 2, "baseline_results", lines, F.col("variant"), RATE_METRICS),
        (baseline_logistic, 2, "baseline_results", lines, F.col("variant"), RATE_METRICS),
        (view_validation, 3, "view_validation", lines, F.col("variant"), RATE_METRICS),
        (component_ablation, 4, "clean_ablation", lines, F.col("variant"), RATE_METRICS),
        (
            degradation_curve, 4, "degradation_comparison", lines,
            joined("variant", "view", F.col("rate").cast("string")), ["auc", "brier", "auc_loss"],
        ),
        (cross_dataset, 5, "cross_dataset_results", F.col("test_dataset"), joined(F.lit("fit"), "fit_dataset"), RATE_METRICS),
        (efficiency_table, 6, "efficiency_table", events, F.col("stage"), ["total_seconds", "median_seconds", "p95_seconds"]),
        (
            scalability_table, 6, "scalability_table", events,
            joined("stage", F.col("rows").cast("string")), ["mean_seconds", "rows_per_second"],
        ),
        (
            stored_scores, 7, "cv_scores", events,
            joined("model", "metric", F.col("repeat").cast("string"), F.col("fold").cast("string")), ["value"],
        ),
        (score_summary, 7, "score_summary", events, joined("model", "metric"), ["mean", "sd"]),
        (paired_t_test, 7, "paired_tests", events, joined("versus", "metric"), ["t", "effect_size"]),
        (signed_rank_test, 7, "paired_tests", events, joined("versus", "metric"), ["w", "z"]),
        (permutation_test, 7, "paired_tests", events, joined("versus", "metric"), ["p"]),
    ]


RUN = "main"
# Experiments that start first.
LONGEST = (stored_scores, degradation_curve)


def record(spark: SparkSession, sf_dir: str, store: str, outputs: list[tuple], run: str = RUN) -> None:
    """Run experiments and append their results, at full precision, and their lineage to a store.

    Experiments run side by side, the longest first; what they share is built by the first that
    needs it. Lineage is recorded in the order of ``outputs``; results are appended by one job.
    """
    steps = B.steps_of(spark, sf_dir)

    def ran(run_query, experiment, output, dataset, subject, numbers) -> tuple[DataFrame, int, set[str]]:
        steps.begin()
        try:
            with full_precision():
                results = stage(C.as_results(run_query(spark, sf_dir), experiment, output, dataset, subject, numbers), output)
            return results, results.count(), steps.drop()
        except BaseException:
            steps.drop()
            raise

    order = sorted(range(len(outputs)), key=lambda k: outputs[k][0] not in LONGEST)
    done = dict(zip(order, side_by_side(spark, [partial(ran, *outputs[k]) for k in order])))
    S.record_results(reduce(DataFrame.unionByName, [C.consolidate([done[k][0]]) for k in sorted(order)]), store, run)
    written = {}
    for k, (run_query, experiment, output, *_) in enumerate(outputs):
        _, n, used = done[k]
        node = S.result_node(experiment, output)
        written[node] = written.get(node, 0) + n
        steps.begin()
        for known in used:
            steps.uses(known)
        before = {i for (o, i) in steps.rows if o == node and i}
        for known in before:  # an output of several queries has the inputs of all of them
            steps.uses(known)
        steps.end(node, run_query.__name__, {"seed": splits.SEED, "folds": CV_FOLDS, "repeats": CV_REPEATS})
    rows = {**B.staged_rows(spark, sf_dir), **written}
    for (output, node), step in list(steps.rows.items()):
        steps.rows[output, node] = (*step[:4], rows.get(output))
        if node and node.startswith("table:"):
            steps.rows[node, None] = (node, None, "source", json.dumps({"folder": sf_dir}), rows[node])
    S.record_steps(spark, steps, store, run)


def record_claims(spark: SparkSession, sf_dir: str, store: str, run: str = RUN) -> None:
    """Experiment 8: the claims matrix over what the store has, stored in its turn."""
    steps = B.steps_of(spark, sf_dir)
    results = S.read_results(spark, store, [run]).where("experiment < 8")
    matrix = claims_matrix_of(spark, results)
    cells = [c for c in matrix.columns if c.startswith("experiment_")]
    rows = stage(C.as_results(matrix, 8, "claims_matrix", F.lit("claims"), F.col("claim_id"), cells), "claims_matrix")
    S.record_results(rows, store, run)
    steps.begin()
    for output in sorted({c[2] for c in CLAIMS}):
        experiment = next(e for e, _, o in C.EXPERIMENTS if o == output)
        steps.uses(S.result_node(experiment, output))
    steps.end(S.result_node(8, "claims_matrix"), "claims_matrix", {"claims": len(CLAIMS)}, rows.count())
    S.record_steps(spark, steps, store, run)


_stores: dict[tuple[str, str], str] = {}


def recorded_store(spark: SparkSession, sf_dir: str) -> str:
    """The folder of this session's results: experiments run once, before anything is consolidated."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _stores:
        store = fresh_path(spark, "store")
        record(spark, sf_dir, store, experiment_outputs())
        record_claims(spark, sf_dir, store)
        _stores[key] = store
    return _stores[key]


# From here on queries read the store and nothing else.


@query
def consolidated_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(S.read_results(spark, recorded_store(spark, sf_dir), [RUN]))


# Claim, the output that would support it, and its metric.
CLAIMS = [
    ("c1", "fused evidence ranks at least as well as single views", "view_validation", "auc"),
    ("c2", "every component contributes on clean data", "clean_ablation", "auc"),
    ("c3", "scores carry over to the other dataset", "cross_dataset_results", "auc"),
    ("c4", "averages are stable over repeats", "score_summary", "sd"),
    ("c5", "runs scale with the input", "scalability_table", "rows_per_second"),
    ("c6", "fused evidence holds against conventional models", "baseline_results", "auc"),
]


def claims_matrix_of(spark: SparkSession, results: DataFrame) -> DataFrame:
    claims = spark.createDataFrame(CLAIMS, "claim_id string, text string, output string, metric string")
    matrix = C.claims_matrix(claims, C.link_evidence(claims, results))
    cells = [c for c in matrix.columns if c.startswith("experiment_")]
    return matrix.withColumns({c: F.col(c).cast("double") for c in cells})


@query
def claims_to_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    results = S.read_results(spark, recorded_store(spark, sf_dir), [RUN])
    return claims_matrix_of(spark, results.where("experiment < 8"))


@query
def output_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    results = S.read_results(spark, recorded_store(spark, sf_dir), [RUN])
    missing = C.missing_outputs(results).select("experiment", "output", F.lit(True).alias("missing"))
    index = C.results_index(results).join(missing, ["experiment", "output"], "left")
    return index.withColumn("missing", F.coalesce("missing", F.lit(False)))


@query
def result_lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stored result with each table it came from, by the recorded steps."""
    store = recorded_store(spark, sf_dir)
    traced = S.trace_results(S.read_results(spark, store, [RUN]), S.read_steps(spark, store, [RUN]))
    return traced.select("result_id", "source", "source_rows")


@query
def publication_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    results = S.read_results(spark, recorded_store(spark, sf_dir), [RUN])
    return rounded(C.publication_table(results, "clean_ablation", RATE_METRICS))


# ---- comparison of all models -------------------------------------------------


@query
def friedman_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean ranks of all models over repeats and folds, and whether they differ."""
    return rounded(inference.friedman(stored_scores(spark, sf_dir), ["metric"]), 5)


@query
def adjusted_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paired t-tests with Holm's correction over the models that a metric is compared with."""
    tests = stats.paired_t(stored_diffs(spark, sf_dir), ["versus", "metric"])
    out = inference.holm(tests, ["metric"], "versus")
    return rounded(out.select("versus", "metric", "n", "mean_diff", "p", "p_holm"), 5)


@query
def bootstrap_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brier score of every variant on test rows, with an interval from resampled orders."""
    test = B.split_rows(line_fused(spark, sf_dir), "test")
    long = X.score_variants(test, X.standard_variants(LINE_VIEWS), ["entity", "y"])
    miss = (F.col("s") - F.col("y")) * (F.col("s") - F.col("y"))
    return rounded(inference.bootstrap_means(long.withColumn("miss", miss), ["variant"], "miss", "entity"))


# ---- uncertainty of rankings --------------------------------------------------


@query
def auc_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E2 with DeLong's interval, per variant and split."""
    rows = line_fused(spark, sf_dir)
    long = X.score_variants(rows, X.standard_variants(LINE_VIEWS), ["split", "y"])
    return rounded(auctest.auc_interval(long, ["variant", "split"]))


@query
def auc_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Is the fused score ranked better than each view and the plain mean, on test rows?"""
    test = B.split_rows(line_fused(spark, sf_dir), "test")
    out = auctest.auc_differences(test, X.standard_variants(LINE_VIEWS), "reliability")
    return rounded(out.withColumn("z", F.round("z", 3)))


# ---- second scorer ----------------------------------------------------------


def line_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trees of all line views, fitted on train rows."""
    fitted = lambda: trees.fit_trees(B.split_rows(B.line_evidence(spark, sf_dir), "train"), LINE_VIEWS)
    return B.once(spark, sf_dir, "line_trees", fitted)


def line_tree_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trees.score_views(B.line_evidence(spark, sf_dir), LINE_VIEWS, line_trees(spark, sf_dir))


@query
def tree_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = line_trees(spark, sf_dir).withColumn("node", F.col("node").cast("long"))
    return rounded(nodes.select("view", "node", "n", "p", "feature", "threshold", "gain", "score"))


@query
def tree_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = line_tree_scores(spark, sf_dir)
    return rounded(scored.select("record_id", *[f"p_{v}" for v in LINE_VIEWS.names]))


@query
def tree_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E4 with trees as scorers: weights, coefficients and thresholds are fitted for their scores."""
    scored = line_tree_scores(spark, sf_dir)
    val = B.split_rows(scored, "validation")
    weights = B.once(spark, sf_dir, "tree_weights", lambda: fusion.fit_view_weights(val, LINE_VIEWS))
    fitted = lambda: fusion.fit_alpha(with_scalar(val, weights, "_G"), LINE_VIEWS, ALPHA_GRID)
    alpha = B.once(spark, sf_dir, "tree_alpha", fitted)
    rows = fusion.fuse(
        with_scalar(with_scalar(scored, weights, "_G"), alpha, "_A"),
        LINE_VIEWS, fusion.weight_columns(LINE_VIEWS, "_G"), fusion.alpha_columns("_A"),
    )
    return rounded(
        X.validate_views(B.split_rows(rows, "validation"), B.split_rows(rows, "test"), LINE_VIEWS)
    )


# ---- baselines --------------------------------------------------------------


def _baseline_scores(
    rows: DataFrame, features: list[str] | str, names: list[str], scored: DataFrame | None = None
) -> DataFrame:
    """Predictions of every baseline for ``scored`` (or all rows), fitted on the train rows only."""
    train = B.split_rows(rows, "train")
    prepared = fit_preparation(train, features)
    fits = [partial(fit_baseline, train, features, name, prepared=prepared) for name in names]
    models = dict(zip(names, side_by_side(rows.sparkSession, fits)))
    return score_baselines(rows if scored is None else scored, models, ["split", "y"])


@query
def baseline_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Binary baselines on all line features: thresholds from validation, metrics on test."""
    rows = B.line_evidence(spark, sf_dir)
    # Train rows are only fitted: threshold and metrics have no use for their scores.
    used = rows.where(F.col("split").isin("validation", "test"))
    scored = _baseline_scores(rows, LINE_VIEWS.features, list(ESTIMATORS), used)
    scored = stage(scored, "baseline_scores", ("split",)).withColumnRenamed("variant", "model")
    val, test = B.split_rows(scored, "validation"), B.split_rows(scored, "test")
    out = X.compare(val, test, {"s": F.col("s")}, ["model"]).drop("variant")
    return rounded(out.withColumnRenamed("model", "variant"))


@query
def baseline_gaussian(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The Gaussian baseline on all line features: threshold from validation, metrics on test."""
    constants = scoring.score_constants(B.line_params(spark, sf_dir), LINE_VIEWS)
    rows = with_scalar(B.line_evidence(spark, sf_dir), constants, "_P")
    models = {"gaussian": X.gaussian_baseline(LINE_VIEWS)}
    return rounded(X.compare(B.split_rows(rows, "validation"), B.split_rows(rows, "test"), models))


def line_logistic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logistic regression on all line features, fitted on train rows; one row."""
    def fitted() -> DataFrame:
        train = B.split_rows(B.line_evidence(spark, sf_dir), "train")
        return logistic.fit_logistic(train, B.line_params(spark, sf_dir), LINE_VIEWS.features, [])

    return B.once(spark, sf_dir, "line_logistic", fitted)


@query
def logistic_coefficients(spark: SparkSession, sf_dir: str) -> DataFrame:
    terms = F.array(*[F.lit(t) for t in ("(intercept)", *LINE_VIEWS.features)])
    pairs = F.arrays_zip(terms.alias("term"), F.col("b"))
    return rounded(line_logistic(spark, sf_dir).select(F.inline(pairs)))


@query
def baseline_logistic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The logistic baseline: threshold from validation, metrics on test."""
    rows = with_scalar(B.line_evidence(spark, sf_dir), line_logistic(spark, sf_dir), "_L")
    models = {"logistic": logistic.probability(LINE_VIEWS.features, "_L")}
    return rounded(X.compare(B.split_rows(rows, "validation"), B.split_rows(rows, "test"), models))


@query
def tuned_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regularisation of the logistic baseline, chosen on validation rows."""
    rows = B.line_evidence(spark, sf_dir)
    grid = [{"regParam": r} for r in (0.0, 0.01, 0.1)]
    train, val = B.split_rows(rows, "train"), B.split_rows(rows, "validation")
    return rounded(tune_baseline(train, val, LINE_VIEWS.features, "logistic_regression", grid))


@query
def complete_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stored results including a run of the library's baselines, which have no SQL."""
    store = recorded_store(spark, sf_dir)
    models = (baseline_models, 2, "baseline_results", F.lit("lines"), F.col("variant"), RATE_METRICS)
    record(spark, sf_dir, store, [models], "baselines")
    return rounded(S.read_results(spark, store, [RUN, "baselines"]))


@query
def baseline_multiclass(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten-class baselines on the whole embedding."""
    v = B.load(spark, sf_dir, "embeddings")
    rows = v.select(
        F.col("vec_id").alias("record_id"),
        F.col("label").alias("y"),
        splits.split_of("vec_id").alias("split"),
        array_to_vector(F.col("embedding").cast("array<double>")).alias("vector"),
    )
    names = ["logistic_regression", "random_forest", "naive_bayes"]
    scored = _baseline_scores(rows, "vector", names)
    hit = F.avg((F.col("pred") == F.col("y")).cast("double"))
    return rounded(
        scored.groupBy("variant", "split").agg(F.count("*").alias("n"), hit.alias("accuracy"))
    )
