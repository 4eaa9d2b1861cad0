"""Vector columns: which are complete, and their components as whole numbers."""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

LIMIT = 1 << 24     # whole components stay below this in size, so that sums of products are exact in 64 bits


def complete(vector: Column) -> Column:
    """Whether a vector is there and all its components are finite numbers."""
    return vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))


def whole(lists: pa.Array, scale: int, size: int) -> np.ndarray:
    """floor(scale * x) of all components, as doubles; a row per vector, shorter vectors end in zeros. A component of LIMIT and more is an error."""
    out = np.zeros((len(lists), size), np.int64)
    n = np.diff(np.asarray(lists.offsets))
    flat = np.floor(lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * scale)
    if len(flat) and np.abs(flat).max() >= LIMIT:
        raise ArithmeticError(f"a component times {scale} is {LIMIT} or more")
    out[np.arange(size) < n[:, None]] = flat
    return out
