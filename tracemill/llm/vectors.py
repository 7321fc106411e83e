"""Rows of a vector table as integer matrices, in slices of bounded size."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Values of one slice at most; a slice has a row at least.
SLICE_VALUES = 1 << 20


def vector_rows(table: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """Columns (vec_id, embedding) alone, with the types that the operators read."""
    return table.select(F.col(id_column).cast("long").alias("vec_id"), F.col(vector_column).cast("array<double>").alias("embedding"))


def kept_vectors(batches, dim: int):
    """(vec_ids, matrix) of the rows whose vector has ``dim`` entries, none of them null or non-finite."""
    for batch in batches:
        step = max(1, SLICE_VALUES // max(1, dim))
        for start in range(0, batch.num_rows, step):
            part = batch.slice(start, step)
            vectors = part.column("embedding")
            fits = pc.equal(pc.fill_null(pc.list_value_length(vectors), -1), dim)
            ids, flat = part.column("vec_id").filter(fits), vectors.filter(fits).flatten()
            matrix = flat.to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(-1, dim)  # null becomes NaN
            whole = np.isfinite(matrix).all(axis=1)
            if whole.any():
                yield ids.filter(pa.array(whole)), matrix[whole]


def scaled(matrix: np.ndarray, limit: int) -> np.ndarray:
    """floor(64 * entry) as integers; beyond ``limit`` in size they stay at it."""
    with np.errstate(over="ignore"):
        return np.clip(np.floor(64.0 * matrix), -float(limit), float(limit)).astype(np.int64)
