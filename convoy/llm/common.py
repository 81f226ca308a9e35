"""Helpers shared by the training-data operators: Arrow text buffers, work
folders and sizing."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.work import discard, materialise, remove_dir, shared_dir, work_dir  # noqa: F401  operators find them here

#: Bytes of text that one step of a vectorised kernel holds at a time.
STEP_BYTES = 1 << 21


#: Functions that empty what a Python worker remembers; operators add theirs.
CACHES: list[Callable[[], None]] = []


_owner = ""


def release_caches(owner: str) -> None:
    """Called where an operator's work starts in a worker: workers are reused, and what
    another operator remembered there would count against this one's memory."""
    global _owner
    if owner == _owner:
        return
    _owner = owner
    for clear in CACHES:
        clear()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # give freed heap back to the system
        ctypes.CDLL(None).malloc_trim(0)


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and the n+1 offsets of its rows; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    if not (pa.types.is_string(column.type) or pa.types.is_binary(column.type)):
        column = column.cast(pa.string())
    if not len(column):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    if column.null_count:
        column = pc.fill_null(column, "" if pa.types.is_string(column.type) else b"")
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return raw[ends[0] : ends[-1]], ends - ends[0]


def steps(offsets: np.ndarray, limit: int = STEP_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most `limit` bytes each, or of one longer row."""
    start, n = 0, len(offsets) - 1
    while start < n:
        end = int(np.searchsorted(offsets, offsets[start] + limit, side="right")) - 1
        end = min(max(end, start + 1), n)
        yield start, end
        start = end


#: Estimates beyond this (a petabyte) are Catalyst's way of saying that it doesn't know.
UNKNOWN_BYTES = 1 << 50


def table_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate of the input, without running a job; where it has none,
    the bytes of the text columns, counted."""
    known = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if known < UNKNOWN_BYTES:
        return known
    texts = [F.octet_length(F.col(f"`{f.name}`").cast("string")) for f in df.schema if isinstance(f.dataType, T.StringType | T.BinaryType)]
    total = sum((F.coalesce(t, F.lit(0)).cast("long") for t in texts), F.lit(8))
    return int(df.agg(F.sum(total)).first()[0] or 0)
