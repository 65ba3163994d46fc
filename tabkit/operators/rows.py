"""Choosing rows: missing values, positions, splits, folds and samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tabkit.functions.scalars import hash_bucket, hash_text, hash_unit
from tabkit.operators.agg import na_share
from tabkit.operators.order import SPAN_ROWS, as_columns, null_safe_join, with_position


def drop_na(df: DataFrame, cols=None) -> DataFrame:
    """Drop rows with a NULL in any of the columns (all columns by default)."""
    return df.dropna("any", subset=None if cols is None else list(cols))


def split_by(df: DataFrame, cond: Column) -> tuple[DataFrame, DataFrame]:
    """Rows where the condition is true, and rows where it is false; NULL goes to neither."""
    return df.filter(cond), df.filter(~cond)


def slice_rows(df: DataFrame, order, lo: int, hi: int, span_rows: int = SPAN_ROWS) -> DataFrame:
    """Rows lo..hi (1-based, both included) in the given order."""
    if lo <= 1 and hi <= 10_000:
        return df.orderBy(*as_columns(order)).limit(hi)
    placed = with_position(df, order, name="_at", span_rows=span_rows)
    return placed.filter(F.col("_at").between(lo, hi)).drop("_at")


def drop_positions(df: DataFrame, order, positions, span_rows: int = SPAN_ROWS) -> DataFrame:
    """All rows but those at the given positions: a list, or a frame with column ``position``."""
    placed = with_position(df, order, name="position", span_rows=span_rows)
    if isinstance(positions, DataFrame):
        return placed.join(positions.select(F.col("position").cast("bigint")).distinct(), "position",
                           "left_anti").drop("position")
    return placed.filter(~F.col("position").isin([int(p) for p in positions])).drop("position")


def keep_frequent(df: DataFrame, col: str, min_count: int) -> DataFrame:
    """Rows whose value occurs at least ``min_count`` times."""
    common = df.groupBy(col).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= min_count).select(col)
    return null_safe_join(df, common, [col], "left_semi")


def sparse_columns(df: DataFrame, threshold: float) -> list[str]:
    return [r["column"] for r in na_share(df).filter(F.col("na_share") > threshold).collect()]


def drop_sparse_columns(df: DataFrame, threshold: float) -> DataFrame:
    """Drop columns with more than the given share of NULLs (one pass over all columns)."""
    return df.drop(*sparse_columns(df, threshold))


def sample_split(df: DataFrame, key: str, n: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """Rows of n randomly chosen entities, and the rows of all others."""
    chosen = df.select(key).distinct().orderBy(hash_text(F.col(key), seed=seed), F.col(key)).limit(n)
    return df.join(chosen, key, "left_semi"), df.join(chosen, key, "left_anti")


def train_test_split(df: DataFrame, key: str, frac: float, seed: int) -> tuple[DataFrame, DataFrame]:
    """Split by a hash of the key; the same key always lands on the same side."""
    u = hash_unit(F.col(key), seed=seed)
    return df.filter(u < frac), df.filter(u >= frac)


def kfold(df: DataFrame, key: str, k: int, seed: int, name: str = "fold") -> DataFrame:
    """Assign every row to one of k folds by a hash of its key."""
    return df.withColumn(name, hash_bucket(F.col(key), buckets=k, seed=seed))


def sample_per_group(df: DataFrame, keys, row_key, n: int, seed: int) -> DataFrame:
    """Up to n randomly chosen rows per group; ranks are cut map-side before the shuffle."""
    row_key = [row_key] if isinstance(row_key, str) else list(row_key)
    cols = as_columns(row_key)
    w = W.partitionBy(*keys).orderBy(hash_text(*cols, seed=seed), *cols)
    return df.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= n).drop("_r")
