"""Arrow batches in Python workers: few bytes at a time, and memory given back."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession


def lean(spark: SparkSession) -> None:
    """Arrow batches of 4 MB instead of 64, so that neither the JVM nor Python holds many whole texts at once; a session that has its own setting keeps it."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key) in ("67108864b", "67108864", "64m", "64MB"):
        spark.conf.set(key, str(4 << 20))


def slices(batches: Iterator[pa.RecordBatch], rows: int = 500, most: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of few rows and, but for single rows that are longer, of `most` bytes of text, so that Python never holds many texts at once."""
    for batch in batches:
        sizes = np.zeros(batch.num_rows, np.int64)
        for c in batch.columns:
            if pa.types.is_string(c.type) or pa.types.is_binary(c.type):
                sizes += pc.fill_null(pc.binary_length(c), 0).to_numpy(zero_copy_only=False)
        reach, at = np.cumsum(sizes), 0
        while at < batch.num_rows:
            end = int(np.searchsorted(reach, most + (reach[at - 1] if at else 0), "right"))
            end = max(at + 1, min(at + rows, end))
            yield batch.slice(at, end - at)
            at = end


def release() -> None:
    """Gives memory that is free in this process back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc alone has it
    if trim is not None:
        trim(0)
