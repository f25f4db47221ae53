"""Integer vectors from arrays of floating-point numbers, for the operators on embeddings."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Products and sums of integers below this are exact as doubles.
EXACT = 1 << 53
LONG = 1 << 63


def scaled(vec_col: str, scale: int, offset: int = 0) -> Column:
    """Each component x as the integer floor(scale * x) + offset, x read as a double (null for a null vector)."""
    return F.transform(F.col(f"`{vec_col}`"), lambda c: F.floor(c.cast("double") * F.lit(float(scale))) + F.lit(offset).cast("bigint"))


def whole(vec_col: str) -> Column:
    """Whether a vector is not null and all its components are finite numbers."""
    v = F.col(f"`{vec_col}`")
    # NaN is larger than infinity, so the comparison leaves it out, too
    return F.coalesce(v.isNotNull() & F.forall(v, lambda c: c.isNotNull() & (F.abs(c.cast("double")) < F.lit(float("inf")))), F.lit(False))


def common_length(rows: DataFrame, col: str = "x") -> int:
    """The most frequent length of the arrays in ``col`` (of several, the largest); 0 where there are no rows."""
    got = rows.groupBy(F.size(col).alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    return int(got["d"]) if got else 0


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    """Arrow lists of equal length as an int64 matrix."""
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False).reshape(len(column), dims)


def dots(rows: np.ndarray, vector: np.ndarray) -> np.ndarray:
    """Exact inner products of integer rows with an integer vector; raises where they may exceed 64 bits."""
    most = int(np.abs(rows).max(initial=0)) * int(np.abs(vector).max(initial=0)) * max(1, len(vector))
    if most < EXACT:
        return (rows.astype(np.float64) @ vector.astype(np.float64)).astype(np.int64)
    if most < LONG:
        return rows @ vector
    raise OverflowError("inner products of these vectors exceed 64 bits; use a smaller scale")
