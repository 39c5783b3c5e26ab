"""What a Python worker is handed at a time, and what it keeps afterwards."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import SparkSession

#: Rows and bytes of an Arrow batch. Rows are lines, most of them short; a batch is in memory several times.
BATCH_ROWS, BATCH_BYTES = 2000, 1 << 20


def small_batches(spark: SparkSession) -> None:
    """Lower the session's limits on an Arrow batch, if they are higher."""
    parse = spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes
    rows, size = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"
    if not 0 < int(spark.conf.get(rows)) <= BATCH_ROWS:
        spark.conf.set(rows, BATCH_ROWS)
    if not 0 < parse(spark.conf.get(size)) <= BATCH_BYTES:
        spark.conf.set(size, BATCH_BYTES)


def trimmed(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run`` over a task's batches; after it, freed memory goes back to the system, as the worker stays alive beside later stages."""

    def wrapped(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):  # glibc only
                ctypes.CDLL(None).malloc_trim(0)

    return wrapped
