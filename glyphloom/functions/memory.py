"""What Python workers hold: rows of whole documents come few at a time, and free memory goes back after a task."""

import ctypes
import sys
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import SparkSession

_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def small_batches(spark: SparkSession) -> None:
    """Let Arrow batches hold few rows, which here are whole texts, unless the session asks for another number."""
    if spark.conf.get(_BATCH) == "10000":
        spark.conf.set(_BATCH, "1000")


def slim() -> None:
    """Give memory that is free back to the system.

    Python workers are reused, and what each of them keeps for later counts with the executor's memory in all stages after.
    """
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux" and (trim := getattr(ctypes.CDLL(None), "malloc_trim", None)):
        trim(0)


def lean(run: Callable) -> Callable:
    """``run``, which works on a task's batches, after which its worker is slim again."""
    def batches_of(batches):
        yield from run(batches)
        slim()
    return batches_of


def together(batches, rows: int = 10_000):
    """Batches of short rows put together until they hold ``rows`` rows: fewer, larger steps."""
    held, size = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            size += batch.num_rows
        if size >= rows:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, size = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
