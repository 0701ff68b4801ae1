"""Adding up integer arrays of a fixed size over all tasks, block by block."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

BLOCK = 1 << 15                # numbers per block
ADDERS = 16
BLOCK_SCHEMA = "block bigint, sums binary"


def pack(x: np.ndarray) -> bytes:
    """Bytes of an integer array, planes apart, compressed; the length goes in front."""
    planes = x.view(np.uint8).reshape(len(x), x.itemsize).T.tobytes()
    return np.int64(len(x)).tobytes() + pa.compress(planes, "zstd", asbytes=True) if len(x) else b""


def unpack(b: bytes, kind) -> np.ndarray:
    if not b:
        return np.zeros(0, kind)
    n, size = int(np.frombuffer(b[:8], np.int64)[0]), np.dtype(kind).itemsize
    raw = pa.decompress(b[8:], n * size, "zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(size, n).T).view(kind).ravel()


def blocks(total: np.ndarray) -> Iterator[pa.RecordBatch]:
    """A task's part of the sum, as rows (block, sums); blocks of zeros are left out."""
    for i in range(0, len(total), BLOCK):
        b = total[i:i + BLOCK]
        if b.any():
            yield pa.RecordBatch.from_arrays([pa.array([i // BLOCK]), pa.array([pack(b)], pa.binary())], ["block", "sums"])


def added_up(parts: DataFrame, size: int) -> np.ndarray:
    """The sum of all tasks' arrays of ``size`` numbers: blocks are added up by shuffle, a block at a time in memory."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for row in batch.to_pylist():
                x = unpack(row["sums"], np.int64)
                total[row["block"]] = total[row["block"]] + x if row["block"] in total else x
        for i, b in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([i]), pa.array([pack(b)], pa.binary())], ["block", "sums"])

    out = np.zeros(size, np.int64)
    n = max(1, min(ADDERS, -(-size // BLOCK)))
    for block, sums in parts.repartition(n, "block").mapInArrow(add, BLOCK_SCHEMA).collect():
        x = unpack(bytes(sums), np.int64)
        out[block * BLOCK:block * BLOCK + len(x)] = x
    return out
