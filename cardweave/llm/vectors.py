"""Helpers of the operators on embedding vectors: what is a vector, Arrow batches as matrices, sums over partitions."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Partial results of more partitions than this are added up on executors before the driver sees them.
PARTS = 256
FAN_IN = 64


def finite(vector_col: str) -> Column:
    """Whether a vector is there and holds neither null nor NaN nor an infinity."""
    v = F.col(vector_col)
    # NaN is greater than anything to Spark, so one test is enough.
    return v.isNotNull() & F.coalesce(F.forall(v, lambda x: x.isNotNull() & (F.abs(x.cast("double")) < F.lit(float("inf")))), F.lit(False))


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """A column of lists of ``dim`` numbers as a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dim)


def packed(column: pa.Array, dtype, dim: int) -> np.ndarray:
    """A column of binaries, each the numbers of a row, as a matrix."""
    return np.frombuffer(b"".join(column.to_pylist()), dtype).reshape(len(column), dim)


def add_up(df: DataFrame, part: Callable[[Iterator[pa.RecordBatch]], np.ndarray]) -> np.ndarray:
    """The sum over partitions of the float64 array that ``part`` makes of each.

    Arrays are of one shape, which does not grow with the table. Where there are many
    partitions the arrays are added up on executors, level by level, so the driver
    gets ``PARTS`` of them at most.
    """

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = part(batches)
        yield pa.RecordBatch.from_arrays([pa.array([list(out.shape)], pa.list_(pa.int32())), pa.array([out.astype(np.float64).tobytes()], pa.binary())], ["shape", "m"])

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, shape = None, None
        for b in batches:
            for s, m in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                total, shape = np.frombuffer(m, np.float64) + (0 if total is None else total), s
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([shape], pa.list_(pa.int32())), pa.array([total.tobytes()], pa.binary())], ["shape", "m"])

    parts, level = df.rdd.getNumPartitions(), df.mapInArrow(first, "shape array<int>, m binary")
    while parts > PARTS:
        parts = -(-parts // FAN_IN)
        level = level.repartition(parts).mapInArrow(again, "shape array<int>, m binary")
    rows = level.collect()
    if not rows:
        return np.zeros(0)
    return np.sum([np.frombuffer(bytes(r["m"]), np.float64).reshape(r["shape"]) for r in rows], axis=0)
