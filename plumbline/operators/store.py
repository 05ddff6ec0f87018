"""The result store and the recorded lineage.

Experiments append; consolidation only reads. A result is one row per stored number, named by
``result_id``; recording it again in the same run replaces it, whichever attempt wrote last, so
a repeated or resumed experiment leaves the store as one that ran once. Nothing is rewritten:
older attempts stay as files.

Lineage is a graph of recorded steps: whatever writes a table or results records its output,
each of its inputs, its operator, its parameters and its rows. A recursive query walks it from
any output back to the source tables.
"""

from __future__ import annotations

import json
import threading
import time
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RESULT = "result_id string, experiment int, output string, dataset string, subject string, metric string, value double"
STEP = "output string, input string, operator string, parameters string, rows long"
_KEPT = [c.split()[0] for c in RESULT.split(", ")]


def result_node(experiment: int, output: str) -> str:
    return f"result:{experiment}/{output}"


def _appended(df: DataFrame, path: str, run: str) -> None:
    stamped = df.withColumns({"run": F.lit(run), "attempt": F.lit(time.time_ns())})
    stamped.write.mode("append").partitionBy("run").parquet(path)


def record_results(results: DataFrame, store: str, run: str) -> None:
    """Append results (see ``consolidate.as_results``) to a run; a repeated id within them fails."""
    _appended(results.select(*_KEPT), f"{store}/results", run)


def read_results(spark: SparkSession, store: str, runs: Iterable[str]) -> DataFrame:
    """Results of the runs: of each id the last attempt of the last run that is named."""
    order = {r: k for k, r in enumerate(runs)}
    rank = F.element_at(F.create_map(*[F.lit(x) for p in order.items() for x in p]), F.col("run"))
    rows = spark.read.schema(f"{RESULT}, run string, attempt long").parquet(f"{store}/results")
    rows = rows.where(F.col("run").isin(list(order)))
    rest = F.struct(*_KEPT[1:])
    last = F.max_by(rest, F.struct(rank.alias("nth"), "attempt")).alias("row")
    return rows.groupBy("result_id").agg(last).select("result_id", "row.*")


class Steps:
    """Steps of one run, gathered on the driver while plans are built: a few rows a stage.

    Experiments may be built side by side: each thread has its own open steps.
    """

    def __init__(self):
        self.rows: dict[tuple[str, str | None], tuple] = {}
        self._local = threading.local()

    @property
    def _open(self) -> list[set[str]]:
        return self._local.__dict__.setdefault("open", [])

    def uses(self, node: str) -> None:
        """The table or stage ``node`` is an input of whatever is being built."""
        if self._open:
            self._open[-1].add(node)

    def begin(self) -> None:
        self._open.append(set())

    def end(self, output: str, operator: str, parameters: dict | None = None, rows: int | None = None) -> None:
        inputs = self._open.pop()
        for node in sorted(inputs) or [None]:
            self.rows[output, node] = (output, node, operator, json.dumps(parameters or {}, sort_keys=True), rows)

    def drop(self) -> set[str]:
        """Closes a step that is not recorded here; returns its inputs."""
        return self._open.pop()


def record_steps(spark: SparkSession, steps: Steps, store: str, run: str) -> None:
    _appended(spark.createDataFrame(list(steps.rows.values()), STEP), f"{store}/steps", run)


def read_steps(spark: SparkSession, store: str, runs: Iterable[str]) -> DataFrame:
    rows = spark.read.schema(f"{STEP}, run string, attempt long").parquet(f"{store}/steps")
    rows = rows.where(F.col("run").isin(list(runs)))
    last = F.max_by(F.struct("operator", "parameters", "rows"), "attempt").alias("step")
    return rows.groupBy("output", "input").agg(last).select("output", "input", "step.*")


def sources(steps: DataFrame) -> DataFrame:
    """output, source, steps (least number between them) and source_rows, for every recorded
    output and source. A source is a step with the operator ``source``; an input that nothing
    recorded ends its chain without one."""
    spark = steps.sparkSession
    walked = spark.sql(
        """
        WITH RECURSIVE walk(output, node, steps) AS (
          SELECT DISTINCT output, output, 0 FROM {steps}
          UNION ALL
          SELECT w.output, s.input, w.steps + 1 FROM walk AS w JOIN {steps} AS s ON s.output = w.node
          WHERE s.input IS NOT NULL)
        SELECT output, node, min(steps) AS steps FROM walk GROUP BY output, node
        """,
        steps=steps,
    )
    roots = steps.where("operator = 'source'").select(F.col("output").alias("node"), F.col("rows").alias("source_rows"))
    return walked.join(roots, "node").select("output", F.col("node").alias("source"), "steps", "source_rows")


def trace_results(results: DataFrame, steps: DataFrame) -> DataFrame:
    """Every result with each of its sources; a result whose chain is broken keeps one row without."""
    chains = sources(steps).where("steps > 0")
    node = F.concat_ws("", F.lit("result:"), F.col("experiment").cast("string"), F.lit("/"), F.col("output"))
    named = results.select("result_id", node.alias("_node"))
    chains = chains.withColumnRenamed("output", "_node")
    return named.join(chains, "_node", "left").select("result_id", "source", "steps", "source_rows")
