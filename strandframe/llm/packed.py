"""Hash-keyed numpy columns that travel as a few large rows, one per flush and bucket."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Entries a worker gathers before it sends them on; bytes of entries a bucket is meant to hold.
FLUSH, BUCKET_BYTES = 1_000_000, 16 << 20


def n_buckets(entries: int, width: int) -> int:
    """Buckets so that each holds about BUCKET_BYTES, whatever the input."""
    return max(16, -(-entries * width // BUCKET_BYTES))


def give_back() -> None:
    """Returns freed memory to the system: workers are kept between tasks, and with them what they once held."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim:
        trim(0)


def schema(columns: int) -> str:
    return "bucket int, " + ", ".join(f"c{i} binary" for i in range(columns))


def dealt(keys: np.ndarray, columns: list[np.ndarray], n: int) -> Iterator[pa.RecordBatch]:
    """Rows of schema(), the entries dealt to n buckets by the high bits of their key."""
    if not len(keys):
        return
    bucket = ((keys >> np.uint64(32)) * np.uint64(n)) >> np.uint64(32)
    order = np.argsort(bucket, kind="stable")
    at = np.flatnonzero(np.diff(bucket[order], prepend=np.uint64(n + 1)))
    bounds = np.append(at, len(order))
    names = [int(b) for b in bucket[order][at]]
    blobs = [[c[order[lo:hi]].tobytes() for lo, hi in zip(bounds[:-1], bounds[1:], strict=True)] for c in columns]
    yield pa.RecordBatch.from_arrays([pa.array(names, pa.int32()), *[pa.array(b, pa.binary()) for b in blobs]], names=["bucket", *[f"c{i}" for i in range(len(columns))]])


def column(table: pa.Table, i: int, dtype) -> np.ndarray:
    """Column i of all rows of a bucket, as one array."""
    return np.frombuffer(b"".join(table[f"c{i}"].to_pylist()), dtype)


def by_bucket(df: DataFrame, f, out: str) -> DataFrame:
    """f(arrow table of one bucket) -> arrow table, for each bucket."""
    return df.groupBy("bucket").applyInArrow(f, out)
