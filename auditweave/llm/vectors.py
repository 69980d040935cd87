"""What the vector operators share."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def usable(rows: DataFrame, column: str = "embedding"):
    """Condition: the vector is there, not zero, and all of its components are finite numbers."""
    v = F.col(column)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    some = F.exists(v, lambda x: x.cast("double") != 0)
    return v.isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.coalesce(some, F.lit(False))


def matrix(column, dtype=np.float64) -> np.ndarray:
    """An Arrow list column of equally long vectors as a matrix."""
    n = len(column)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(dtype)
    return flat.reshape(n, -1) if n else flat.reshape(0, 0)
