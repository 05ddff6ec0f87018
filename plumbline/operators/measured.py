"""A log of the stages that really ran: rows and seconds of each, for S9, C1 and C2."""

from __future__ import annotations

import time
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession

from plumbline.session import stage
from plumbline.sources.sinks import append_run_log

SCHEMA = "run_id string, stage string, rows long, seconds double, started timestamp"


class Measured:
    """Runs stages and keeps one row for each in the driver; ``save`` appends them to a run log.

    Rows are those of the files that the stage left, counted from their footers once the clock
    has stopped; a task that is repeated because an executor was lost counts once. A stage that
    fails leaves no row, and rows that are saved once are not saved again. Times are in UTC.

    Plans are not observed: after that a session cannot send its tasks a fitted ``pyspark.ml``
    model that holds a training summary.
    """

    def __init__(self, spark: SparkSession, run_id: str):
        self.spark, self.run_id, self.entries = spark, run_id, []

    def stage(self, df: DataFrame, name: str, partition_by: tuple[str, ...] = ()) -> DataFrame:
        started, clock = datetime.now(timezone.utc), time.monotonic()
        table = stage(df, name, partition_by)
        seconds = time.monotonic() - clock
        self.entries.append((self.run_id, name, table.count(), seconds, started))
        return table

    def save(self, path: str) -> None:
        if self.entries:
            append_run_log(self.spark.createDataFrame(self.entries, SCHEMA).coalesce(1), path)
        self.entries = []
