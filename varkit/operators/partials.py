"""Sums and factors of a whole table from partial results of its partitions.

A partition is read as Arrow batches and leaves one small array; ``FAN_IN`` tasks merge the arrays as a
stream, in the order of the partitions, and the driver merges what is left.  So neither the number of
rows nor the number of partitions shows in any task's memory.
"""

from __future__ import annotations

from typing import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FAN_IN = 32


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    return np.column_stack([c.to_numpy(zero_copy_only=False).astype(np.float64, copy=False) for c in batch.columns])


def merged(x: DataFrame, scan: Callable[[Iterator[np.ndarray]], np.ndarray | None],
           merge: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray | None:
    """``merge`` of ``scan`` over the partitions of ``x`` (double columns, no NULL); None without rows.
    ``scan`` gets a partition's batches as (rows, columns) arrays and returns a 2-d array or None."""
    def packed(part: np.ndarray, place: int) -> pa.RecordBatch:
        part = np.ascontiguousarray(part, np.float64)
        return pa.RecordBatch.from_arrays([pa.array([place], pa.int32()), pa.array([part.shape[1]], pa.int32()), pa.array([part.tobytes()], pa.binary())],
                                          ["g", "width", "m"])

    def unpacked(width: int, data: bytes) -> np.ndarray:
        return np.frombuffer(data, np.float64).reshape(-1, width)

    def leave(batches):
        from pyspark import TaskContext
        part = scan(_matrix(b) for b in batches if b.num_rows)
        if part is not None:
            yield packed(part, TaskContext.get().partitionId())

    def fold(batches):
        total, first = None, 0
        for b in batches:
            for g, width, data in zip(*[c.to_pylist() for c in b.columns]):
                part = unpacked(width, data)
                total, first = (part, g) if total is None else (merge(total, part), first)
        if total is not None:
            yield packed(total, first)

    schema = "g int, width int, m binary"
    rows = x.mapInArrow(leave, schema).repartition(FAN_IN, F.col("g") % FAN_IN).sortWithinPartitions("g").mapInArrow(fold, schema)
    total = None
    for r in sorted(rows.collect(), key=lambda r: r["g"]):
        part = unpacked(r["width"], bytes(r["m"]))
        total = part if total is None else merge(total, part)
    return total
