"""Reading vectors: what counts as one, and Arrow lists as matrices."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def valid(table: DataFrame, dim: int | None = None) -> DataFrame:
    """(vec_id, embedding) of rows with an id and a vector of `dim` elements, or of the table's commonest length (of the longest, on a
    tie), that holds no null, NaN or infinity; the others are left out."""
    v = table.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<float>").alias("embedding"))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    v = v.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & (F.size("embedding") > 0)).where(finite)
    if dim:
        return v.where(F.size("embedding") == dim)
    size = v.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return v.where(F.size("embedding") == (size["d"] if size else 0))


def matrix(column: pa.Array, dtype=np.float64) -> np.ndarray:
    """Rows of a list column of equal lengths."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1).astype(dtype, copy=False) if len(column) else np.zeros((0, 0), dtype)
