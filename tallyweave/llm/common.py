"""Reading tables, keeping intermediate tables in the shared folder, and numpy views of Arrow columns."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tallyweave.session import shared_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame) -> DataFrame:
    """Write once to the folder that all executors share and read back: cuts the lineage and survives lost executors."""
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/llm-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def trim() -> None:
    """Hand free memory of this process back: Arrow's pool, and the heap that numpy and Python took their arrays from."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library keeps its own rules
        pass


def released(task: Callable) -> Callable:
    """A task over record batches that hands the memory of its batches back at its end; workers live on."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from task(batches)
        finally:
            trim()
    return run


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column end to end, and the offsets of its rows (null: empty)."""
    if column.null_count:
        column = column.fill_null("")
    column = pa.concat_arrays([column]) if column.offset else column
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int32, len(column) + 1, column.offset * 4).astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offs[0]:offs[-1]], offs - offs[0]


def slices(offs: np.ndarray, size: int) -> Iterator[tuple[int, int]]:
    """Runs of rows of about ``size`` bytes; a longer row is a run of its own."""
    start, last = 0, len(offs) - 1
    while start < last:
        end = int(np.searchsorted(offs, offs[start] + size, side="right")) - 1
        end = min(max(end, start + 1), last)
        yield start, end
        start = end
