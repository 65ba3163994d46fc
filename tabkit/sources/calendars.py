"""Generated calendars and parameter grids."""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabkit.functions.scalars import is_weekend


def calendar(spark: SparkSession, start, end, name: str = "date") -> DataFrame:
    """One row per day from start to end, both included."""
    bounds = spark.range(1).select(F.lit(start).cast("date").alias("a"), F.lit(end).cast("date").alias("b"))
    return bounds.select(F.explode(F.sequence("a", "b", F.expr("interval 1 day"))).alias(name))


def calendar_of(df: DataFrame, col: str, name: str = "date") -> DataFrame:
    """Calendar from the first to the last day found in a column."""
    bounds = df.agg(F.min(F.to_date(col)).alias("a"), F.max(F.to_date(col)).alias("b"))
    return bounds.filter("a IS NOT NULL").select(
        F.explode(F.sequence("a", "b", F.expr("interval 1 day"))).alias(name))


def day_type_calendar(days: DataFrame, date: str = "date", weekend: str = "Holiday", weekday: str = "Workday",
                      locale: str = "Ordinary") -> DataFrame:
    """Weekend or working day for every date, with the default locale."""
    return days.select(
        F.col(date),
        F.when(is_weekend(F.col(date)), weekend).otherwise(weekday).alias("day_type"),
        F.lit(locale).alias("locale"),
    )


def param_grid(**lists) -> list[dict]:
    """Every combination of the given values, the first name varying slowest."""
    names = list(lists)
    return [dict(zip(names, combo)) for combo in itertools.product(*lists.values())]


def param_grid_table(spark: SparkSession, **lists) -> DataFrame:
    """The same combinations as a table."""
    return spark.createDataFrame([tuple(p.values()) for p in param_grid(**lists)], list(lists))
