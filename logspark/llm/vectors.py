"""Which vectors take part in cosine operators, and their Arrow form as matrices."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable() -> Column:
    """Neither null nor empty nor zero, without null or non-finite components, and with an id."""
    bad = F.exists("embedding", lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))
    some = F.exists("embedding", lambda e: e != 0)
    return F.coalesce(F.col("vec_id").isNotNull() & ~bad & some, F.lit(False))


def widths(rows: DataFrame) -> dict[int, int]:
    """How many rows have vectors of each width.  There are at most as many widths as the widest vector has components."""
    counts = rows.groupBy(F.size("embedding").alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return {r["w"]: r["n"] for r in counts.collect()}


def by_width(batch: pa.RecordBatch, column: str = "embedding") -> Iterator[tuple[int, pa.RecordBatch]]:
    """(width, its rows) for each width that a batch holds; vectors of different widths have no cosine."""
    sizes = pc.list_value_length(batch.column(column)).to_numpy(zero_copy_only=False)
    for width in np.unique(sizes).tolist():
        yield width, batch if (sizes == width).all() else batch.filter(pa.array(sizes == width))


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Rows of equal length as float64."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 1)


def directions(rows: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1; each row's result depends on that row alone."""
    largest = np.abs(rows).max(axis=1, keepdims=True)
    rows = rows / largest
    return rows / np.sqrt(np.einsum("ij,ij->i", rows, rows))[:, None]
