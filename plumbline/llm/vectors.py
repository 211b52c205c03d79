"""Vector columns: which rows take part, and Arrow lists as matrices."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def finite(vec: Column, most: float | None = None) -> Column:
    """Whether a vector is there, has components, and all of them are numbers (of magnitude ``most`` at most)."""

    def good(x: Column) -> Column:
        ok = x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf"))
        return ok if most is None else ok & (F.abs(x.cast("double")) <= most)

    return F.coalesce((F.size(vec) > 0) & F.forall(vec, good), F.lit(False))


def usable(rows: DataFrame, good: Column, id_col: str, vec_col: str) -> tuple[DataFrame, int]:
    """The rows with a good vector of one length, and that length: that of the smallest id's longest good vector.

    Without such rows the length is 0.
    """
    rows = rows.where(good)
    size = F.size(vec_col)
    first = rows.select(F.col(id_col).alias("i"), size.alias("n")).orderBy(F.asc_nulls_last("i"), F.desc("n")).first()
    d = first["n"] if first else 0
    return rows.where(size == d), d


def matrix(column: pa.Array | pa.ChunkedArray, d: int) -> np.ndarray:
    """An Arrow list column as rows of doubles."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, d)
