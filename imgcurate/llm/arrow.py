"""Columns computed in Arrow batches, a bounded number of bytes at a time."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

SLICE_BYTES = 4 << 20


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """``batch`` in runs of rows whose ``column`` holds about ``limit`` bytes; one longer row is a run alone."""
    if batch.num_rows == 0:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    total, start, held = np.cumsum(sizes, dtype=np.int64), 0, 0
    while start < len(sizes):
        stop = max(start + 1, int(np.searchsorted(total, held + limit, side="right")))
        yield batch.slice(start, stop - start)
        start, held = stop, int(total[stop - 1])


def map_slices(
    df: DataFrame,
    make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch]],
    schema: T.StructType | str,
    column: str,
    limit: int = SLICE_BYTES,
) -> DataFrame:
    """``mapInArrow`` over bounded slices. ``make`` runs once a task and gives the function of a slice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make()
        for batch in batches:
            for part in slices(batch, column, limit):
                made = step(part)
                if made.num_rows:
                    yield made
        del step
        give_back()

    return df.mapInArrow(run, schema)


def give_back() -> None:
    """Free memory goes back to the machine at the end of a task, as idle workers would keep it."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def added(df: DataFrame, *fields: tuple[str, T.DataType], dropped: tuple[str, ...] = ()) -> T.StructType:
    """The schema of ``df`` without ``dropped``, then ``fields``, which replace columns of their names."""
    names = {n for n, _ in fields} | set(dropped)
    kept = [f for f in df.schema.fields if f.name not in names]
    return T.StructType([*kept, *(T.StructField(n, t, True) for n, t in fields)])


def with_arrays(part: pa.RecordBatch, schema_names: list[str], **arrays) -> pa.RecordBatch:
    """Columns of ``part`` named in ``schema_names``, those in ``arrays`` taken from there."""
    return pa.RecordBatch.from_arrays(
        [arrays[n] if n in arrays else part.column(n) for n in schema_names], names=schema_names
    )


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the offsets of its rows; null counts as empty."""
    column = pc.fill_null(column, "")
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    held = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return held, offsets - offsets[0]
