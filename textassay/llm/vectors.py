"""Integer vectors from columns of floating-point arrays."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def is_finite(vector: Column) -> Column:
    """Whether a vector is there and has neither null nor non-finite components; an empty one passes."""
    def good(x):
        return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))

    return vector.isNotNull() & F.coalesce(F.forall(vector, good), F.lit(False))


def scaled(column: pa.Array, scale: int, limit: int) -> np.ndarray:
    """``floor(scale * x)`` of every component as whole numbers, one row per vector.

    Vectors shorter than the longest of the batch end in zeros. A magnitude of ``limit`` or more is an
    error, as results would not fit into their columns.
    """
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = np.diff(column.offsets.to_numpy())
    whole = np.floor(scale * column.flatten().to_numpy(zero_copy_only=False).astype(np.float64))
    if len(whole) and np.abs(whole).max() >= limit:
        raise OverflowError(f"a component times {scale} is {limit} or more in magnitude")
    width = int(lengths.max(initial=0))
    out = np.zeros((len(lengths), width), np.int64)
    out[np.arange(width) < lengths[:, None]] = whole
    return out
