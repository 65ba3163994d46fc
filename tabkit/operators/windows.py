"""Neighbouring rows and group statistics on rows.

``split=None`` counts the rows of the largest key first; pass ``split=False`` where keys are
short by construction (one row per day of a calendar) to save that job.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabkit.functions.scalars import round_even
from tabkit.operators.order import SPAN_ROWS, fill, medians, null_safe_join, over_rows

__all__ = ["add_lags", "add_leads", "drop_superseded", "fill", "group_mean", "group_median", "rolling_mean",
           "smooth_local", "zscore"]


def add_lags(df: DataFrame, keys, order, col: str, lags, span_rows: int = SPAN_ROWS,
             split: bool | None = None) -> DataFrame:
    """Values k rows back within the key, as ``<col>_lag_<k>``."""
    return over_rows(df, keys, order, lambda w: {f"{col}_lag_{k}": F.lag(col, k).over(w) for k in lags},
                     before=max(lags), span_rows=span_rows, split=split)


def add_leads(df: DataFrame, keys, order, cols, k: int = 1, span_rows: int = SPAN_ROWS,
              split: bool | None = None) -> DataFrame:
    """Values k rows ahead within the key, as ``next_<col>``."""
    return over_rows(df, keys, order, lambda w: {f"next_{c}": F.lead(c, k).over(w) for c in cols},
                     after=k, span_rows=span_rows, split=split)


def rolling_mean(df: DataFrame, keys, order, col: str, n: int, name: str | None = None,
                 span_rows: int = SPAN_ROWS,
                 split: bool | None = None) -> DataFrame:
    """Mean of the last n rows including this one; NULLs are skipped and one value is enough."""
    return over_rows(df, keys, order,
                     lambda w: {name or f"{col}_mean_{n}": F.avg(col).over(w.rowsBetween(-(n - 1), 0))},
                     before=n - 1, span_rows=span_rows, split=split)


def group_mean(df: DataFrame, keys, col: str, digits: int | None = None, name: str | None = None) -> DataFrame:
    """Group mean on every row. Aggregated first and joined back, so a hot group is not
    gathered in one task."""
    name = name or f"{col}_mean"
    mean = F.avg(col) if digits is None else round_even(F.avg(col), digits)
    return null_safe_join(df, df.groupBy(*keys).agg(mean.alias(name)), keys)


def group_median(df: DataFrame, keys, cols, span_rows: int = SPAN_ROWS) -> DataFrame:
    """Group medians on every row, as ``<col>_median``."""
    stats = medians(df, cols, keys, span_rows).withColumnsRenamed({c: f"{c}_median" for c in cols})
    return null_safe_join(df, stats, list(keys))


def zscore(df: DataFrame, cols, by=(), suffix: str = "_z") -> DataFrame:
    """(x - mean) / sample sd, overall or per group; NULL where the sd is zero or unknown."""
    stats = df.groupBy(*by).agg(*[e for c in cols for e in (
        F.avg(c).alias(f"_m_{c}"), F.stddev_samp(c).alias(f"_s_{c}"))])
    out = null_safe_join(df, stats, list(by))
    return out.withColumns({
        c + suffix: (F.col(c) - F.col(f"_m_{c}")) / F.nullif(F.col(f"_s_{c}"), F.lit(0.0)) for c in cols
    }).drop(*[f"_{p}_{c}" for c in cols for p in "ms"])


def drop_superseded(df: DataFrame, keys, date: str, kind: str, original: str = "Holiday",
                    replacement: str = "Transfer", days: int = 7, order=(), keep_last: bool = True,
                    span_rows: int = SPAN_ROWS,
                    split: bool | None = None) -> DataFrame:
    """Remove an original entry when its replacement follows as the next entry within some days.

    An entry without a next one stays; with ``keep_last=False`` it goes if it is an original
    (the comparison with nothing is then taken as unknown).
    """
    out = over_rows(df, keys, [date, *order], lambda w: {
        "_next_date": F.lead(date).over(w), "_next_kind": F.lead(kind).over(w)}, after=1, span_rows=span_rows, split=split)
    moved = ((F.col(kind) == original) & (F.col("_next_kind") == replacement)
             & (F.datediff("_next_date", date) <= days))
    keep = F.coalesce(~moved, F.lit(True)) if keep_last else ~moved
    return out.filter(keep).drop("_next_date", "_next_kind")


def smooth_local(df: DataFrame, keys, order, x: str, y: str, half: int, name: str = "smooth",
                 span_rows: int = SPAN_ROWS,
                 split: bool | None = None) -> DataFrame:
    """Fitted value of a straight line through the rows within ``half`` positions."""
    def build(w):
        near = w.rowsBetween(-half, half)
        line = F.regr_intercept(y, x).over(near) + F.regr_slope(y, x).over(near) * F.col(x)
        return {name: F.coalesce(line, F.avg(y).over(near))}

    return over_rows(df, keys, order, build, before=half, after=half, span_rows=span_rows, split=split)
