"""Vectors as rows of packed numbers, and which of them can be compared."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(vector: Column) -> Column:
    """Not null, without null or non-finite components, and not zero."""
    high, low = F.array_max(vector).cast("double"), F.array_min(vector).cast("double")  # NaN counts as the greatest
    bad = F.exists(vector, lambda x: x.isNull())
    return F.coalesce(vector.isNotNull() & (high < float("inf")) & (low > float("-inf")) & ((high > 0) | (low < 0)) & ~bad, F.lit(False))


def kind(df: DataFrame, vector: str) -> type:
    """The numbers that hold a column's components exactly."""
    return np.float32 if "float" in df.schema[vector].dataType.simpleString() else np.float64


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Rows of doubles, from lists of one length."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def by_length(batch: pa.RecordBatch, at: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(rows, their vectors as doubles) for each length of the lists in a column."""
    column = batch.column(at)
    lengths = column.value_lengths().to_numpy(zero_copy_only=False)
    return [(rows, matrix(column.take(pa.array(rows)))) for n in np.unique(lengths) if len(rows := np.flatnonzero(lengths == n))]


def unpacked(column: pa.ChunkedArray, kind: type = np.float64) -> np.ndarray:
    """Rows from binary values of one length."""
    values = column.to_pylist()
    return np.frombuffer(b"".join(values), kind).reshape(len(values), -1)


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1; scaled first, so that squares neither vanish nor overflow."""
    x = x / np.abs(x).max(1, initial=0, keepdims=True) if x.size else x
    return x / np.sqrt((x * x).sum(1))[:, None]


def cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row in doubles, each the same wherever the pair stands."""
    a, b = a.astype(np.float64), b.astype(np.float64)
    return (a * b).sum(1) / (np.sqrt((a * a).sum(1)) * np.sqrt((b * b).sum(1)))


def packed(x: np.ndarray, kind: type = np.float64) -> pa.Array:
    return pa.array([r.tobytes() for r in np.ascontiguousarray(x, kind)], pa.binary())


#: Products of unit vectors in single precision are this near to their cosines, up to some 10,000 components.
ROUNDING = 2e-5
