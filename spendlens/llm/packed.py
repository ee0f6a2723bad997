"""Window hashes moved between tasks in packed rows.

A chunk is a group of texts that one task handles together; its values are dealt out to
buckets by the leading part of their hash, one row per chunk and bucket, as compressed
numpy arrays.  What a bucket finds goes back to the chunk by its number.
"""

from __future__ import annotations

import itertools
import zlib

import numpy as np
from pyspark.sql import DataFrame

#: Text bytes of a chunk.
CHUNK = 4 << 20
ROW = "bucket int, kind int, chunk long, a binary, b binary, c binary"
INDEX, PROBE, TEXTS, DONE = 0, 1, 2, 3


def squeeze(x: np.ndarray) -> bytes:
    """Ascending or slowly changing integers: differences, compressed."""
    return zlib.compress(np.diff(x.astype(np.int64), prepend=0).astype(np.int32).tobytes(), 1)


def unsqueeze(b: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(zlib.decompress(b), dtype=np.int32), dtype=np.int64)


def bucket_of(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """0 .. buckets-1 by the upper half of the hash."""
    return ((hashes >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def by_bucket(hashes: np.ndarray, buckets: int):
    """(bucket, places of its hashes, ascending) for every bucket that has any."""
    own = bucket_of(hashes, buckets)
    order = np.argsort(own.astype(np.uint16) if buckets <= 65536 else own, kind="stable")
    edges = np.searchsorted(own[order], np.arange(buckets + 1))
    for k in range(buckets):
        if edges[k] < edges[k + 1]:
            yield k, order[edges[k] : edges[k + 1]]


def chunk_numbers():
    """Numbers of a task's chunks, one after another: the partition, and a running count within it.

    No two chunks share one.  A task run again gives the same numbers to the same chunks, as long as
    its rows come in the same order: a scan's do, other rows are sorted before they get here."""
    from pyspark import TaskContext

    return itertools.count(TaskContext.get().partitionId() << 32)


def batch(rows: list[tuple]):
    import pyarrow as pa

    cols = list(zip(*rows)) or [()] * 6
    kinds = [pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["bucket", "kind", "chunk", "a", "b", "c"])


def dealt(rows: DataFrame, buckets: int) -> DataFrame:
    """Each bucket's rows in a partition of their own, index rows first."""
    return rows.repartitionById(buckets, rows["bucket"]).sortWithinPartitions("kind", "chunk")


def rows_of(batches):
    for b in batches:
        yield from zip(*(b.column(k).to_pylist() for k in range(6)))
