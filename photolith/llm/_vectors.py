"""Arrow list columns as matrices."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def lengths(column: pa.Array) -> np.ndarray:
    """The number of components of each vector; -1 for null."""
    return pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False).astype(np.int64)


def matrix(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of the rows with exactly `dim` components, and those in double precision; null components are NaN."""
    rows = np.flatnonzero(lengths(column) == dim)
    flat = pc.list_flatten(column.take(pa.array(rows)))
    return rows, pc.cast(flat, pa.float64()).to_numpy(zero_copy_only=False).reshape(len(rows), dim)
