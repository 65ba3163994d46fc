"""Outlier flags, replacement and fences."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabkit.operators.order import SPAN_ROWS, null_safe_join, quantiles
from tabkit.operators.windows import group_median, zscore


def flag_outliers(df: DataFrame, cols, z: float = 3.0, by=()) -> DataFrame:
    """Add ``<col>_outlier``: distance from the mean above z standard deviations."""
    out = zscore(df, cols, by)
    return out.withColumns({
        f"{c}_outlier": F.coalesce(F.abs(F.col(f"{c}_z")) > z, F.lit(False)) for c in cols
    }).drop(*[f"{c}_z" for c in cols])


def replace_outliers(df: DataFrame, cols, by=(), z: float = 3.0, span_rows: int = SPAN_ROWS) -> DataFrame:
    """Replace group-wise outliers by the group median; all statistics are of the input frame."""
    scored = group_median(zscore(df, cols, by), by, cols, span_rows)
    return scored.withColumns({
        c: F.when(F.abs(F.col(f"{c}_z")) > z, F.col(f"{c}_median")).otherwise(F.col(c)) for c in cols
    }).select(*df.columns)


def iqr_filter(df: DataFrame, col: str, k: float = 1.5, by=(), span_rows: int = SPAN_ROWS) -> DataFrame:
    """Rows within k interquartile ranges of the quartiles."""
    q = quantiles(df, [col], [0.25, 0.75], by, span_rows).withColumnRenamed(col, "_q")
    out = null_safe_join(df, q, list(by))
    lo, hi = F.get("_q", F.lit(0)), F.get("_q", F.lit(1))
    return out.filter(F.col(col).between(lo - k * (hi - lo), hi + k * (hi - lo))).drop("_q")
