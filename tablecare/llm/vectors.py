"""Vectors of an Arrow list column as matrices, and matrices as rows of bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def finite(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers and a matrix of doubles for each length of the lists that have entries, all finite and not null."""
    column = column.cast(pa.large_list(pa.float64()))
    bounds = column.offsets.to_numpy()
    values = column.values
    bad = ~np.isfinite(values.fill_null(np.nan).to_numpy(zero_copy_only=False))
    before = np.concatenate([[0], np.cumsum(bad)])
    sizes = np.diff(bounds)
    good = (sizes > 0) & (before[bounds[1:]] == before[bounds[:-1]]) & column.is_valid().to_numpy(zero_copy_only=False)
    data = values.fill_null(0.0).to_numpy(zero_copy_only=False)
    for dim in np.unique(sizes[good]).tolist():
        rows = np.flatnonzero(good & (sizes == dim))
        yield rows, data[bounds[rows][:, None] + np.arange(dim)]


def packed(matrix: np.ndarray) -> pa.Array:
    """Each row's bytes."""
    matrix = np.ascontiguousarray(matrix)
    width = matrix.shape[1] * matrix.itemsize
    ends = np.arange(len(matrix) + 1, dtype=np.int64) * width
    return pa.Array.from_buffers(pa.large_binary(), len(matrix), [None, pa.py_buffer(ends), pa.py_buffer(matrix.tobytes())])


def unpacked(column: pa.Array, rows: np.ndarray, kind: str, dim: int) -> np.ndarray:
    """The matrix whose rows ``packed`` made bytes of."""
    column = column.cast(pa.large_binary())
    starts = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)[rows]
    data = np.frombuffer(column.buffers()[2], np.uint8)
    size = dim * np.dtype(kind).itemsize
    if len(rows) and (np.diff(starts) == size).all():
        flat = data[starts[0] : starts[0] + size * len(rows)]
    else:
        flat = data[starts[:, None] + np.arange(size)]
    return np.ascontiguousarray(flat).reshape(-1).view(kind).reshape(len(rows), dim)
