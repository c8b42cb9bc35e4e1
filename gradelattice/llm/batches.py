"""Arrow batches inside tasks: bounded slices, text columns, packed outputs."""

from __future__ import annotations

import ctypes
import gc
import os
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from urllib.parse import unquote, urlparse

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import SparkSession

SLICE_BYTES = 8 << 20  # working set of a task: text handled at once, longer only for a single longer text


def slices(batches: Iterable[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that ``column`` holds about ``limit`` bytes, or one row if a single row is longer.

    At the end, memory held in reserve goes back, as Python workers live on from task to task.
    """
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        block = (np.cumsum(sizes, dtype=np.int64) - 1).clip(0) // limit
        cuts = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            yield batch.slice(a, b - a)
        del batch
    release()


def release() -> None:
    """Give memory that Arrow and the C library keep in reserve back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


@contextmanager
def small_batches(spark: SparkSession, rows: int):
    """While a step with heavy rows runs, Arrow batches hold at most ``rows`` of them."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def texts(batch: pa.RecordBatch, column: str) -> list[str | None]:
    return batch.column(column).to_pylist()


def raw(batch: pa.RecordBatch, column: str) -> list[bytes | None]:
    """The UTF-8 bytes of a string column."""
    return batch.column(column).cast(pa.binary()).to_pylist()


def binary_lists(flat: np.ndarray, offsets: np.ndarray) -> pa.ListArray:
    """A list column from one flat array and row offsets."""
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(flat))


def locate(uri: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a folder named as Spark names it (a plain path, file:, hdfs:, s3: and so on)."""
    parsed = urlparse(uri)
    if parsed.scheme in ("", "file"):
        return fs.LocalFileSystem(), unquote(parsed.path)
    return fs.FileSystem.from_uri(uri)


def child(path: str, *names: str) -> str:
    return os.path.join(path, *names)
