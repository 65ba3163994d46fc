"""Joins: star, spine, band, any-match, positional and write-back."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabkit.operators.order import SPAN_ROWS, with_position

# Dimension sides carry no broadcast hint: Spark broadcasts them when their size is below
# its threshold, and splits a hot key of the fact side (adaptive skew join) when it is not.


def left_join_all(dfs, on) -> DataFrame:
    """Fold of left joins on one key."""
    return reduce(lambda a, b: a.join(b, on, "left"), dfs)


def join_coalesce(left: DataFrame, right: DataFrame, on, cols) -> DataFrame:
    """Left join in which the right value, where present, replaces the left one."""
    on = [on] if isinstance(on, str) else list(on)
    side = right.select(*on, *[F.col(c).alias(f"_new_{c}") for c in cols])
    out = left.join(side, on, "left")
    return out.withColumns({c: F.coalesce(F.col(f"_new_{c}"), F.col(c)) for c in cols}).drop(
        *[f"_new_{c}" for c in cols]).select(*left.columns)


def enrich(fact: DataFrame, dims) -> DataFrame:
    """Left-join a fact table with (dimension, keys) pairs."""
    return reduce(lambda acc, dim: acc.join(dim[0], dim[1], "left"), dims, fact)


def align_to_spine(df: DataFrame, spine: DataFrame, on: str, keys=()) -> DataFrame:
    """One row per spine value, or per key and spine value; missing ones have NULLs.

    The spine is a calendar, so it fits in one array; each key explodes it in place.
    """
    if not keys:
        return spine.select(on).join(df, on, "left")
    days = spine.agg(F.sort_array(F.collect_set(on))).scalar()
    grid = df.select(*keys).distinct().select(*keys, F.explode(days).alias(on))
    return grid.join(df, [*keys, on], "left")


def band_join(left: DataFrame, right: DataFrame, eq, col: str, width: float, suffix: str = "_r") -> DataFrame:
    """Pairs equal on ``eq`` with |left.col - right.col| <= width.

    An equi-join on buckets of that width: each left row looks into its own bucket and the
    two next to it. The right side should be summarised to one row per value where the
    caller needs counts or sums only, so that pairs do not multiply.
    """
    bucket = F.floor(F.col(col) / F.lit(float(width)))
    near = F.explode(F.array(bucket - 1, bucket, bucket + 1))
    lhs = left.withColumn("_b", near)
    rhs = right.withColumn("_b", bucket)
    rhs = rhs.withColumnsRenamed({c: c + suffix for c in right.columns if c not in set(eq)})
    pairs = lhs.join(rhs, [*eq, "_b"])
    return pairs.filter(F.abs(F.col(col) - F.col(col + suffix)) <= width).drop("_b")


def any_match(left: DataFrame, right: DataFrame, left_set: str, right_set: str) -> DataFrame:
    """Pairs of distinct sets that share an element.

    Sets repeat over many rows, so the pairs are formed between distinct sets only; join
    the result back to the rows on the set columns. Sets must be sorted arrays.
    """
    a = left.select(F.col(left_set).alias("left_set")).distinct().withColumn("_e", F.explode("left_set"))
    b = right.select(F.col(right_set).alias("right_set")).distinct().withColumn("_e", F.explode("right_set"))
    return a.join(b, "_e").select("left_set", "right_set").distinct()


def join_on_order(left: DataFrame, right: DataFrame, left_order, right_order,
                  span_rows: int = SPAN_ROWS) -> DataFrame:
    """Bind columns of two frames by row position."""
    a = with_position(left, left_order, name="_at", span_rows=span_rows)
    b = with_position(right, right_order, name="_at", span_rows=span_rows)
    return a.join(b, "_at").drop("_at")


def backfill(df: DataFrame, pred: DataFrame, key, col: str, pred_col: str = "prediction") -> DataFrame:
    """Fill missing values of a column with the prediction of the same key."""
    keys = [key] if isinstance(key, str) else list(key)
    side = pred.select(*keys, F.col(pred_col).alias("_pred"))
    return df.join(side, keys, "left").withColumn(col, F.coalesce(F.col(col), F.col("_pred"))).drop("_pred").select(
        *df.columns)
