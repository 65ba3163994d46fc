"""Cross products of many columns per key in one grouped pass, and solvers for stacks of small systems.

Sums of products are merged map-side, so neither a long series nor a hot key is gathered. What comes
out is one small matrix per key; those are solved many at a time with numpy.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def vector_sums(df: DataFrame, keys, values: Column, name: str) -> DataFrame:
    """Sum of an array of doubles, place by place, per key. Arrays have one length and no NULLs; no rows give no row."""
    rows = df.select(*keys, array_to_vector(values).alias("_v"), F.lit(0).alias("_all"))
    added = rows.groupBy(*keys, "_all").agg(Summarizer.sum(F.col("_v")).alias("_v"))
    return added.select(*keys, vector_to_array("_v").alias(name))


def product_sums(df: DataFrame, keys, values: str, size: int, name: str) -> DataFrame:
    """Sums of products of each two of the ``size`` places of an array column, per key: the upper triangle by rows."""
    z = F.col(values)
    products = F.flatten(F.transform(z, lambda a, i: F.transform(F.slice(z, i + 1, size), lambda b: a * b)))
    return vector_sums(df, keys, products, name)


def as_stack(column: pa.Array, width: int) -> np.ndarray:
    """A list column with ``width`` numbers in each row as rows of an array."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width).astype(float)


def symmetric(triangles: np.ndarray, size: int) -> np.ndarray:
    """Symmetric matrices from rows of upper triangles."""
    i, j = np.triu_indices(size)
    out = np.zeros((len(triangles), size, size))
    out[:, i, j] = triangles
    out[:, j, i] = triangles
    return out


def solve_stack(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Solve symmetric systems ``a x = b`` (b: stack of columns); singular ones by their pseudo-inverse."""
    try:
        out = np.linalg.solve(a, b)
        if np.isfinite(out).all():
            return out
    except np.linalg.LinAlgError:
        pass
    return np.linalg.pinv(a, hermitian=True) @ b


class Elimination:
    """Gauss-Jordan steps over a stack of cross-product matrices whose last place is the response.

    After columns have been taken in, ``residual`` is the sum of squares that they leave and
    ``coefficients`` are their least-squares coefficients. A column that the others explain is left out.
    """

    def __init__(self, moments: np.ndarray, tolerance: float = 1e-10):
        self.a = moments.copy()
        self.least = tolerance * np.maximum(np.diagonal(moments, axis1=1, axis2=2), 1e-300)
        self.taken = np.zeros(moments.shape[:2], bool)

    def take(self, k: int) -> None:
        pivot = self.a[:, k, k]
        good = pivot > self.least[:, k]
        row = np.where(good[:, None], self.a[:, k] / np.where(good, pivot, 1.0)[:, None], 0.0)
        column = self.a[:, :, k].copy()
        column[:, k] = 0.0
        self.a -= column[:, :, None] * row[:, None, :]
        self.a[:, k] = np.where(good[:, None], row, self.a[:, k])
        self.taken[:, k] = good

    @property
    def residual(self) -> np.ndarray:
        return np.maximum(self.a[:, -1, -1], 0.0)

    @property
    def coefficients(self) -> np.ndarray:
        return np.where(self.taken, self.a[:, :, -1], 0.0)[:, :-1]


def list_column(rows: np.ndarray) -> pa.Array:
    """Rows of an array as a list column."""
    ends = np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.ascontiguousarray(rows, dtype=float).ravel()))
