"""What both vector operators need: which vectors count, and rows to matrices."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def usable(v: Column) -> Column:
    """Not null, not empty, all components finite numbers, and not all zero."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return v.isNotNull() & ~F.exists(v, bad) & F.exists(v, lambda x: x != 0)


def matrix(column: pa.Array | pa.ChunkedArray, kind=np.float64) -> np.ndarray:
    """Rows of one length as a matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    flat = np.asarray(column.flatten(), kind)
    return flat.reshape(n, -1) if n else flat.reshape(0, 0)


def lengths(x: np.ndarray) -> np.ndarray:
    """Of the rows, however small or large their components."""
    most = np.abs(x).max(axis=1)
    return most * np.sqrt(((x / np.where(most > 0, most, 1.0)[:, None]) ** 2).sum(axis=1))


def unit(x: np.ndarray) -> np.ndarray:
    """Rows brought to length one; zero rows stay."""
    most = np.abs(x).max(axis=1, keepdims=True)
    x = x / np.where(most > 0, most, 1.0)
    n = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return x / np.where(n > 0, n, 1.0)


def packed(m: np.ndarray) -> list[bytes]:
    return [row.tobytes() for row in np.ascontiguousarray(m)]


def unpacked(column: pa.Array | pa.ChunkedArray, kind) -> np.ndarray:
    """Rows of equal byte strings as a matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(n, -1) if n else np.zeros((0, 0), kind)
