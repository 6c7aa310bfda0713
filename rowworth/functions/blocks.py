"""Arrow-to-numpy helpers for code that runs inside tasks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """An array-of-numbers column as a 2-D float64 matrix; rows must be filled and equally long."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    rows = len(column)
    if column.null_count or (rows and pc.count_distinct(pc.list_value_length(column)).as_py() > 1):
        raise ValueError("arrays of a feature column must not be null and must have one length")
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(rows, -1) if rows else flat.reshape(0, 0)


def vector(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.to_numpy(zero_copy_only=False)


def sigmoid(x: np.ndarray) -> np.ndarray:
    # split by sign, so that exp never overflows
    out = np.empty_like(x, dtype=np.float64)
    up = x >= 0
    out[up] = 1.0 / (1.0 + np.exp(-x[up]))
    grown = np.exp(x[~up])
    out[~up] = grown / (1.0 + grown)
    return out
