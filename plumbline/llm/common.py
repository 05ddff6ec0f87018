"""Session settings of this package, and what its tasks leave behind."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator
from functools import wraps

import pyarrow as pa
from pyspark.sql import SparkSession

from plumbline.session import configure

#: Rows of an Arrow batch: texts are long, and a task holds a few batches at once.
BATCH_ROWS = 1000


def prepare(spark: SparkSession) -> SparkSession:
    configure(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark


def release() -> None:
    """Give freed memory back to the system: Spark keeps Python workers for later stages."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim:
        trim(0)


def tidy(run: Callable) -> Callable:
    """A function of batches (``mapInArrow``) that releases memory at its start and end."""

    @wraps(run)
    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        try:
            yield from run(batches)
        finally:
            release()

    return tidied


def tidy_group(run: Callable) -> Callable:
    """A function of one group (``applyInArrow``) that releases memory after large groups."""

    @wraps(run)
    def tidied(group: pa.Table) -> pa.Table:
        large = group.nbytes > 4 << 20
        try:
            return run(group)
        finally:
            del group
            if large:
                release()

    return tidied
