"""Checks shared by the vector searches."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def dimensions(rows: DataFrame) -> int:
    """Components of most vectors of ``rows`` that hold any, the smaller number of equally frequent ones; 0 if there are none."""
    size = F.size("embedding").alias("size")
    most = rows.filter("vec_id is not null and size(embedding) > 0").groupBy(size).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "size").first()
    return most["size"] if most else 0


def matrix(column: pa.Array, size: int, nonzero: bool) -> tuple[np.ndarray, np.ndarray]:
    """(rows that take part, their vectors as doubles).

    Null vectors, vectors that hold null or non-finite components, or not ``size`` of them
    take no part; nor do zero vectors if ``nonzero``.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = np.asarray(column.value_lengths().fill_null(0), np.int64)
    at = np.flatnonzero(np.asarray(column.is_valid()) & (sizes > 0) & (sizes == size))
    if not len(at):
        return at, np.zeros((0, size))
    flat = column.take(pa.array(at)).flatten()
    x = flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(at), -1)
    fine = np.isfinite(x).all(axis=1)
    if nonzero:
        fine &= (x != 0).any(axis=1)
    return at[fine], x[fine]
