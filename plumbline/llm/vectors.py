"""Columns of vectors as exact integers, and their Arrow form as numpy matrices."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def usable(vector: Column) -> Column:
    """True for vectors that are not null and have no null, NaN or infinite component; never null itself."""
    return F.coalesce(F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) != F.lit(float("inf")))), F.lit(False))


def quantised(vector: Column, scale: int, limit: int) -> Column:
    """``floor(scale * x)`` of every component ``x``, taken as a double, as an array of int. A component beyond ``limit`` is an error: results
    would not be exact."""
    whole = lambda x: F.floor(x.cast("double") * F.lit(float(scale)))
    beyond = F.raise_error(F.lit(f"a vector's component is beyond {limit} after scaling by {scale}"))
    return F.transform(vector, lambda x: F.when(F.abs(x.cast("double")) * scale <= limit, whole(x)).otherwise(beyond.cast("long")).cast("int"))


def rows_of_lists(column: pa.ListArray, width: int) -> np.ndarray:
    """An Arrow list column, every list ``width`` long, as a matrix of 32-bit integers."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int32, copy=False).reshape(len(column), width)


def rows_of_bytes(column: pa.BinaryArray, width: int, kind: str = "<i4") -> np.ndarray:
    """An Arrow binary column, every cell ``width`` numbers of ``kind``, as a matrix that shares the column's memory."""
    size = np.dtype(kind).itemsize * width
    if not len(column) or not size:
        return np.zeros((len(column), width), kind)
    first = int(np.frombuffer(column.buffers()[1], np.int32, count=1, offset=4 * column.offset)[0])
    return np.frombuffer(column.buffers()[2], kind, count=len(column) * width, offset=first).reshape(len(column), width)


def bytes_of_rows(matrix: np.ndarray) -> pa.Array:
    """The reverse: a matrix as one binary cell a row."""
    matrix = np.ascontiguousarray(matrix)
    n, size = len(matrix), matrix.shape[1] * matrix.itemsize
    offsets = np.arange(n + 1, dtype=np.int32) * np.int32(size)
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(matrix.tobytes())])
