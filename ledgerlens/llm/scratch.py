"""Bounds on memory and disk of long jobs."""

from __future__ import annotations

import ctypes
import gc
import re
import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


#: Bytes of an Arrow batch on its way between the JVM and Python; each task has a few of them at a time on either side.
BATCH_BYTES = 16 << 20


def bound_batches(spark: SparkSession) -> None:
    """Lower the session's limit on the bytes of an Arrow batch to ``BATCH_BYTES``, if it is higher."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(name, None)  # unknown before Spark 4.1
    if now is not None and int(re.match(r"\d+", now)[0]) > BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


def release(spark: SparkSession, *done: DataFrame) -> None:
    """Delete the written tables ``done`` and let Spark drop the shuffle files of steps that nothing refers to.

    Spark's cleaner acts when the driver collects its garbage, which a driver
    with little to do rarely does by itself.
    """
    jvm = spark._jvm
    for table in done:
        for file in table.inputFiles()[:1]:
            path = jvm.org.apache.hadoop.fs.Path(file).getParent()
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    gc.collect()
    jvm.System.gc()


#: Seconds between two times that a task with changing needs gives memory back.
OFTEN_S = 1.0


def _give_back() -> None:
    pa.default_memory_pool().release_unused()
    libc = ctypes.CDLL(None)
    if hasattr(libc, "malloc_trim"):
        libc.malloc_trim(0)


def lean_often(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """As ``lean``, and while the task goes on: before a batch is read, ``OFTEN_S`` after the last time."""

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = time.monotonic()

        def watched() -> Iterator[pa.RecordBatch]:
            nonlocal last
            for batch in batches:
                if time.monotonic() - last > OFTEN_S:
                    _give_back()
                    last = time.monotonic()
                yield batch

        for out in run(watched()):
            yield out
            if time.monotonic() - last > OFTEN_S:
                _give_back()
                last = time.monotonic()
        gc.collect()
        _give_back()

    return held


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` in a worker that gives its memory back when the task ends.

    Workers outlive their tasks; without this an idle one keeps what its
    largest slice took.  Where the C library has no such call, Arrow's own
    pool is given back.
    """

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        gc.collect()
        _give_back()

    return held
