"""The supplied tables as evidence records.

There is no flow data among the tables, so each one is mapped to the common
record schema; operators never see a concrete column name.
"""

from __future__ import annotations

import threading
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.scalars import finite, micros
from plumbline.operators.fusion import fit_view_weights
from plumbline.operators.integrity import integrity_factor
from plumbline.operators.prepare import require_unique
from plumbline.operators.scoring import fit_view_params, score_views
from plumbline.operators.splits import split_of
from plumbline.operators.store import Steps
from plumbline.operators.temporal import temporal_factor, with_gap
from plumbline.operators.views import finite_features, with_quality
from plumbline.session import configure, side_by_side, stage
from plumbline.spec import ViewSpec

EVENT_VIEWS = ViewSpec({"amount": ("value",), "payload": ("k",), "timing": ("gap",)})
EVENT_CLASSES = ["click", "error", "purchase", "signup", "view"]

LINE_VIEWS = ViewSpec(
    {
        "volume": ("l_quantity", "l_extendedprice"),
        "terms": ("l_discount", "l_tax"),
        "timing": ("lag_days",),
    }
)
LINE_DATASETS = ["F", "O"]

DOCUMENT_VIEWS = ViewSpec(
    {"size": ("n_chars", "n_words"), "layout": ("n_lines", "toxic"), "review": ("toxic",)}
)

_staged: dict[tuple[str, str, str], DataFrame] = {}
_steps: dict[tuple[str, str], Steps] = {}
_locks: dict[tuple[str, str, str], threading.RLock] = {}


def steps_of(spark: SparkSession, sf_dir: str) -> Steps:
    """Lineage of what this session has built from a folder."""
    return _steps.setdefault((spark.sparkContext.applicationId, sf_dir), Steps())


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    steps_of(spark, sf_dir).uses(f"table:{table}")
    return configure(spark).read.parquet(f"{sf_dir}/{table}.parquet")


def once(
    spark: SparkSession,
    sf_dir: str,
    name: str,
    build: Callable[[], DataFrame],
    partition_by: tuple[str, ...] = (),
    unique: str | None = None,
) -> DataFrame:
    """Stage a prepared table the first time a session asks for it.

    The preparation stage leaves its records as files that every later stage
    reads, so no query repeats the temporal pass or a fit. Threads that ask for the same
    table wait for the one that builds it; tables depend on each other in one direction.
    """
    key = (spark.sparkContext.applicationId, sf_dir, name)
    steps = steps_of(spark, sf_dir)
    steps.uses(f"stage:{name}")
    with _locks.setdefault(key, threading.RLock()):
        if key not in _staged:
            steps.begin()
            try:
                table = stage(build(), name, partition_by)
            except BaseException:
                steps.drop()
                raise
            steps.end(f"stage:{name}", build.__qualname__.removesuffix(".<lambda>").removesuffix(".<locals>"), {"partition_by": list(partition_by)})
            _staged[key] = require_unique(table, unique) if unique else table
        return _staged[key]


def forget_staged() -> None:
    _staged.clear()
    _steps.clear()


def staged_rows(spark: SparkSession, sf_dir: str) -> dict[str, int]:
    """Rows of every staged table and every table read: counted from file footers."""
    app = spark.sparkContext.applicationId
    tables = {f"stage:{n}": t for (a, f, n), t in list(_staged.items()) if (a, f) == (app, sf_dir)}
    read = {i for (_, i) in steps_of(spark, sf_dir).rows if i and i.startswith("table:")}
    for node in sorted(read):
        tables[node] = spark.read.parquet(f"{sf_dir}/{node.removeprefix('table:')}.parquet")
    return dict(zip(tables, side_by_side(spark, [t.count for t in tables.values()])))


def event_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as records: entity is the user, class 1 is an error."""
    e = load(spark, sf_dir, "events")
    return e.select(
        F.col("event_id").alias("record_id"),
        F.col("user_id").alias("entity"),
        micros("ts").alias("ts_us"),
        F.col("event_type").alias("class"),
        (F.col("event_type") == "error").cast("int").alias("y"),
        split_of("event_id").alias("split"),
        finite("value").alias("value"),
        F.get_json_object("props", "$.k").try_cast("double").alias("k"),
    )


def event_evidence_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = finite_features(with_gap(event_records(spark, sf_dir)), EVENT_VIEWS)
    return with_quality(
        records.withColumns({"i": F.lit(1.0), "t": temporal_factor()}), EVENT_VIEWS
    )


def event_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Staged by split, so that a fit reads only the directories it may use."""
    return once(
        spark,
        sf_dir,
        "event_evidence",
        lambda: event_evidence_plan(spark, sf_dir),
        partition_by=("split",),
        unique="record_id",
    )


def split_rows(df: DataFrame, split: str) -> DataFrame:
    return df.where(F.col("split") == split)


def event_params(spark: SparkSession, sf_dir: str) -> DataFrame:
    return once(
        spark,
        sf_dir,
        "event_params",
        lambda: fit_view_params(split_rows(event_evidence(spark, sf_dir), "train"), EVENT_VIEWS),
    )


def event_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Staged evidence with ``p_<view>`` added; row-local, not staged."""
    return score_views(event_evidence(spark, sf_dir), EVENT_VIEWS, event_params(spark, sf_dir))


def event_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return once(
        spark,
        sf_dir,
        "event_weights",
        lambda: fit_view_weights(split_rows(event_scores(spark, sf_dir), "validation"), EVENT_VIEWS),
    )


def line_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``lineitem`` with its order: dataset is the line status, class 1 a return.

    Both tables are large, so this stays a shuffled join; a hot order key is
    split by the adaptive skew join. The order status stands in for the status
    of the acquired file.
    """
    lines = load(spark, sf_dir, "lineitem")
    orders = load(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", "o_orderstatus")
    joined = lines.join(orders, lines.l_orderkey == orders.o_orderkey, "left")
    ship, order = micros("l_shipdate"), micros("o_orderdate")
    lag_seconds = (ship - order) / F.lit(1e6)
    status = (
        F.when(F.col("o_orderstatus") == "F", "verified")
        .when(F.col("o_orderstatus") == "P", "mismatch")
        .otherwise("unlisted")
    )
    return joined.select(
        line_key().alias("record_id"),
        F.col("l_linestatus").alias("dataset"),
        F.col("l_orderkey").alias("entity"),
        ship.alias("ts_us"),
        F.col("l_returnflag").alias("class"),
        (F.col("l_returnflag") == "R").cast("int").alias("y"),
        status.alias("status"),
        lag_seconds.alias("lag_seconds"),
        (lag_seconds / F.lit(86_400.0)).alias("lag_days"),
        "l_quantity",
        "l_extendedprice",
        "l_discount",
        "l_tax",
    )


def line_key():
    """Five columns identify a line; the price is written in cents."""
    cents = F.floor(F.col("l_extendedprice") * F.lit(100.0) + F.lit(0.5))
    return F.concat_ws(
        "|",
        *[F.col(c).cast("string") for c in ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")],
        cents.cast("string"),
    )


def line_evidence_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_evidence_of(line_records(spark, sf_dir))


def line_evidence_of(records: DataFrame) -> DataFrame:
    return with_quality(
        finite_features(records, LINE_VIEWS).withColumns(
            {
                "split": split_of("record_id"),
                "i": integrity_factor("status"),
                "t": temporal_factor(gap="lag_seconds", in_order=F.col("lag_seconds") >= 0),
            }
        ),
        LINE_VIEWS,
    )


def line_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return once(
        spark,
        sf_dir,
        "line_evidence",
        lambda: line_evidence_plan(spark, sf_dir),
        partition_by=("split",),
        unique="record_id",
    )


def line_params(spark: SparkSession, sf_dir: str) -> DataFrame:
    return once(
        spark,
        sf_dir,
        "line_params",
        lambda: fit_view_params(split_rows(line_evidence(spark, sf_dir), "train"), LINE_VIEWS),
    )


def line_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_views(line_evidence(spark, sf_dir), LINE_VIEWS, line_params(spark, sf_dir))


def line_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return once(
        spark,
        sf_dir,
        "line_weights",
        lambda: fit_view_weights(split_rows(line_scores(spark, sf_dir), "validation"), LINE_VIEWS),
    )


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with their labels where they have any (whole texts)."""
    d = load(spark, sf_dir, "documents")
    occurrences = lambda s: F.length("text") - F.length(F.replace(F.col("text"), F.lit(s), F.lit("")))
    return d.join(load(spark, sf_dir, "labels"), "doc_id", "left").select(
        F.col("doc_id").alias("record_id"),
        F.concat_ws("/", "source", "lang").alias("file"),
        F.col("lang").alias("dataset"),
        "text",
        F.col("n_chars").cast("double").alias("n_chars"),
        (occurrences(" ") + 1).cast("double").alias("n_words"),
        (occurrences("\n") + 1).cast("double").alias("n_lines"),
        F.col("quality").alias("y"),
        F.col("toxic").cast("double").alias("toxic"),
    )


def document_digests(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Recorded and recomputed digests, one document standing in for one file.

    Labelled documents were recorded; those marked toxic were altered since, and
    those of low quality are gone.
    """
    d = documents(spark, sf_dir)
    then = F.when(F.col("toxic") == 1, F.concat("text", F.lit("~"))).otherwise(F.col("text"))
    recorded = d.where(F.col("y").isNotNull()).select(
        F.col("record_id").alias("file"), F.sha2(then, 256).alias("sha256")
    )
    present = d.where(F.coalesce("y", F.lit(1)) == 1)
    return recorded, present.select(
        F.col("record_id").alias("file"), F.sha2("text", 256).alias("sha256")
    )


def document_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per (source, language) standing in for a file, with its status.

    The digest covers every document's id and text: digests of single documents are added up,
    which merges over tasks, whatever the size and order of a file.
    """
    d = documents(spark, sf_dir)
    status = (
        F.when(F.count("toxic") == 0, "unlisted").when(F.max("toxic") == 1, "mismatch").otherwise("verified")
    )
    size = F.sum("n_chars").cast("long")
    own = F.substring(F.sha2(F.concat_ws("|", F.col("record_id").cast("string"), F.coalesce("text", F.lit(""))), 256), 1, 15)
    content = F.sum(F.conv(own, 16, 10).cast("decimal(28, 0)")).cast("string")
    return d.groupBy("file").agg(
        size.alias("length"),
        F.sha2(F.concat_ws("|", "file", F.count("*").cast("string"), content), 256).alias("sha256"),
        status.alias("status"),
    )


def run_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` read as an execution log: stage, input size and seconds."""
    e = load(spark, sf_dir, "events")
    return e.select(
        F.col("event_id").cast("string").alias("run_id"),
        F.col("event_type").alias("stage"),
        F.get_json_object("props", "$.k").try_cast("long").alias("rows"),
        F.col("value").alias("seconds"),
        F.col("ts").cast("timestamp").alias("started"),
    )
