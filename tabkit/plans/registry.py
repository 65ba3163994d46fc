"""Queries by name, with the SQL statement that gives the same rows where one exists."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a function of (spark, folder) under a name, with its SQL statement."""
    def register(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def r4(c, digits: int = 4):
    """Rounded for comparison: sums of doubles differ in their last bits between engines."""
    return F.round(F.col(c) if isinstance(c, str) else c, digits)


# Input frames shared by several queries, in Spark and in SQL.

def customer_gaps(spark, folder) -> DataFrame:
    """Customers with missing balances."""
    return table(spark, folder, "customer").withColumn(
        "bal", F.when(F.col("c_custkey") % 7 != 0, F.col("c_acctbal")))


CUSTOMER_GAPS = "(SELECT *, CASE WHEN c_custkey % 7 <> 0 THEN c_acctbal END AS bal FROM customer)"


def daily_facts(spark, folder) -> DataFrame:
    """Quantity sold per order priority and day."""
    orders = table(spark, folder, "orders").select(
        "o_orderkey", F.col("o_orderpriority").alias("prio"), F.to_date("o_orderdate").alias("d"))
    per_order = table(spark, folder, "lineitem").groupBy("l_orderkey").agg(F.sum("l_quantity").alias("q"))
    return (orders.join(per_order, F.col("o_orderkey") == F.col("l_orderkey"))
            .groupBy("prio", "d").agg(F.sum("q").alias("qty")))


DAILY_FACTS = """SELECT o_orderpriority AS prio, CAST(o_orderdate AS DATE) AS d, SUM(l_quantity) AS qty
    FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1, 2"""


def daily_panel(spark, folder) -> DataFrame:
    """Every priority on every day, with the quantity missing on every fifth day of a month."""
    from tabkit.operators.joins import align_to_spine
    from tabkit.sources.calendars import calendar_of

    facts = daily_facts(spark, folder)
    spine = calendar_of(table(spark, folder, "orders"), "o_orderdate", "d")
    return align_to_spine(facts, spine, "d", ["prio"]).withColumn(
        "qty", F.when(F.dayofmonth("d") % 5 != 0, F.col("qty")))


DAILY_CTE = f"""facts AS ({DAILY_FACTS}),
spine AS (SELECT CAST(UNNEST(generate_series(
        (SELECT MIN(CAST(o_orderdate AS DATE)) FROM orders),
        (SELECT MAX(CAST(o_orderdate AS DATE)) FROM orders), INTERVAL 1 DAY)) AS DATE) AS d),
panel AS (SELECT k.prio, s.d, CASE WHEN day(s.d) % 5 <> 0 THEN f.qty END AS qty
    FROM (SELECT DISTINCT prio FROM facts) k CROSS JOIN spine s
    LEFT JOIN facts f ON f.prio = k.prio AND f.d = s.d)"""


def hash_sql(key: str, seed: int) -> str:
    return f"md5('{seed}:' || CAST({key} AS VARCHAR))"


def unit_sql(key: str, seed: int) -> str:
    return f"(CAST(CAST('0x' || substr({hash_sql(key, seed)}, 1, 8) AS BIGINT) AS DOUBLE) / 4294967296.0)"
