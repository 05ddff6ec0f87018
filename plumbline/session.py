"""Session settings and the shared folder for staged tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession

# Runtime settings every query relies on.
RUNTIME = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # The JVM does not compile methods of more than 8000 bytes of bytecode. A
    # stage beyond that, e.g. with very many features, runs faster when Spark
    # splits its expressions instead of fusing the whole stage.
    "spark.sql.codegen.hugeMethodLimit": "8000",
    # Jobs run side by side: a small table may wait for tasks of other jobs.
    "spark.sql.broadcastTimeout": "3600",
}
# Jobs that a session plans and submits at the same time.
SIDE_BY_SIDE = 6


def configure(spark: SparkSession) -> SparkSession:
    for key, value in RUNTIME.items():
        spark.conf.set(key, value)
    return spark


def side_by_side(spark: SparkSession, calls: list[Callable], at_once: int = SIDE_BY_SIDE) -> Iterator:
    """Results of calls that start jobs, in their order; the first that fails is raised.

    Jobs of small tables leave most of a cluster idle, because planning them takes longer than
    running them: while one is planned, tasks of the others run.
    """
    with ThreadPoolExecutor(at_once) as pool:
        running = [pool.submit(inheritable_thread_target(spark)(call)) for call in calls]
        try:
            for one in running:
                yield one.result()
        finally:
            for one in running:
                one.cancel()


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Only a local session without that setting gets a folder of its own; on a
    cluster a machine-local folder would not be visible to the executors.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not (spark.conf.get("spark.master", "") or "").startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
    folder = tempfile.mkdtemp(prefix="plumbline-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def fresh_path(spark: SparkSession, name: str) -> str:
    app = spark.conf.get("spark.app.id", "app")
    return f"{shared_dir(spark)}/plumbline/{app}/{name}-{uuid.uuid4().hex[:12]}"


def stage(df: DataFrame, name: str, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts the lineage, survives lost executors, and gives the planner the true
    size on disk, so that it can decide on a broadcast by itself. Keys of many digits make up
    most of a staged table: zstd writes about 30 % less of them than the default codec.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    writer = df.write.mode("errorifexists").option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
