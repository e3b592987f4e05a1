"""Small helpers for Arrow batches inside tasks."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import types as T

#: Rows and bytes of an Arrow batch at most. Whole texts are long rows: at Spark's own bounds, a batch and its copies in the
#: executor and its workers take hundreds of MB.
BATCH_ROWS, BATCH_BYTES = 2_000, 16 << 20


def replaced(batch: pa.RecordBatch, name: str, column: pa.Array) -> pa.RecordBatch:
    """The batch with the column last, in place of any other of that name."""
    kept = [(n, batch.column(k)) for k, n in enumerate(batch.schema.names) if n != name]
    return pa.RecordBatch.from_arrays([*(c for _, c in kept), column], names=[*(n for n, _ in kept), name])


def with_field(schema: T.StructType, name: str, kind: T.DataType) -> T.StructType:
    """The schema with the field last, in place of any other of that name."""
    return T.StructType([*(f for f in schema.fields if f.name != name), T.StructField(name, kind)])


def small_batches(spark: SparkSession) -> None:
    """Bounds the session's Arrow batches, unless they are smaller already."""
    rows, size = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"
    if not 0 < int(spark.conf.get(rows)) <= BATCH_ROWS:
        spark.conf.set(rows, str(BATCH_ROWS))
    own = spark.conf.get(size).lower().removesuffix("b")
    if not (own.isdigit() and 0 < int(own) <= BATCH_BYTES):
        spark.conf.set(size, f"{BATCH_BYTES}b")


def tidied(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable:
    """The function, giving memory back to the system when a task ends: workers outlive tasks, and what they keep of one
    stage is missing in the next."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return whole


def give_back() -> None:
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # only some C libraries have it
    if trim:
        trim(0)
