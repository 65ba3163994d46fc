"""Scans, projections, filters, joins and sets over the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabkit.functions import scalars as S
from tabkit.operators import agg, columns, joins, rows
from tabkit.plans.registry import (CUSTOMER_GAPS, DAILY_CTE, customer_gaps, daily_facts,
                                   hash_sql, query, r4, table, unit_sql)
from tabkit.sources import calendars, readers, sinks, workspace

# ---- scans and sinks


@query("a1_scan_tokens", """
SELECT c_custkey, c_name, c_nationkey,
       CASE WHEN c_custkey % 10 > 3 THEN c_acctbal END AS c_acctbal,
       CASE WHEN c_custkey % 10 <> 4 THEN c_mktsegment END AS c_mktsegment
FROM (SELECT c_custkey, c_name, CAST(c_nationkey AS BIGINT) AS c_nationkey, c_acctbal, c_mktsegment FROM customer)""")
def a1(spark, sf):
    last = F.col("c_custkey") % 10
    messy = table(spark, sf, "customer").withColumns({
        "c_acctbal": F.when(last == 0, "N/A").when(last == 1, "NA").when(last == 2, ".").when(last == 3, "")
        .otherwise(F.col("c_acctbal").cast("string")),
        "c_mktsegment": F.when(last == 4, " NaN ").otherwise(F.col("c_mktsegment"))})
    return readers.read_table(spark, sinks.write_table(messy, workspace.new_path(spark, "scan")))


@query("a3_parse_dates", """
SELECT CAST(o_orderdate AS DATE) AS day, COUNT(*) AS n FROM orders GROUP BY 1""")
def a3(spark, sf):
    folder = workspace.new_path(spark, "folder")
    text = table(spark, sf, "orders").select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("date"))
    sinks.write_table(text, folder + "/orders.csv")
    schema = T.StructType([T.StructField("o_orderkey", T.LongType()), T.StructField("date", T.StringType())])
    got = readers.read_directory(spark, folder, schemas={"orders": schema})["orders"]
    return got.groupBy(F.to_date("date").alias("day")).agg(F.count("o_orderkey").alias("n"))


@query("a4_clean_names", """
SELECT p_partkey, p_name AS p_name_percent, p_brand, p_type AS x2nd_type, p_size, p_retailprice AS p_size_2 FROM part""")
def a4(spark, sf):
    messy = table(spark, sf, "part").toDF("PPartkey", "P Name %", "p.brand", "2ndType", "p_size", "pSize")
    return columns.clean_names(messy)


@query("a5_underscore_names", "SELECT r_regionkey AS Region_Key, r_name AS Region_Name FROM region")
def a5(spark, sf):
    return columns.underscore_names(table(spark, sf, "region").toDF("Region Key", "Region Name"))


@query("a6_na_profile", f"""
WITH c AS {CUSTOMER_GAPS}, o AS (SELECT *, CASE WHEN o_orderstatus <> 'P' THEN o_totalprice END AS price FROM orders)
SELECT 'customer' AS "table", k AS "column", CASE WHEN k = 'bal' THEN (SELECT COUNT(*) - COUNT(bal) FROM c) ELSE 0 END AS na_count
FROM (SELECT UNNEST(['c_custkey','c_name','c_nationkey','c_acctbal','c_mktsegment','bal']) AS k)
UNION ALL
SELECT 'orders', k, CASE WHEN k = 'price' THEN (SELECT COUNT(*) - COUNT(price) FROM o) ELSE 0 END
FROM (SELECT UNNEST(['o_orderkey','o_custkey','o_orderstatus','o_totalprice','o_orderdate','o_orderpriority','price']) AS k)""")
def a6(spark, sf):
    orders = table(spark, sf, "orders").withColumn("price", F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice")))
    return agg.na_profile({"customer": customer_gaps(spark, sf), "orders": orders})


@query("a7_na_share", f"""
WITH c AS {CUSTOMER_GAPS}
SELECT k AS "column", CASE WHEN k = 'bal' THEN (SELECT COUNT(*) - COUNT(bal) FROM c) ELSE 0 END AS na_count,
       CASE WHEN k = 'bal' THEN (SELECT round(1.0 - COUNT(bal) / CAST(COUNT(*) AS DOUBLE), 4) FROM c) ELSE 0.0 END AS na_share
FROM (SELECT UNNEST(['c_custkey','c_name','c_nationkey','c_acctbal','c_mktsegment','bal']) AS k)""")
def a7(spark, sf):
    return agg.na_share(customer_gaps(spark, sf)).withColumn("na_share", r4("na_share"))


@query("a8_cardinality", f"""
WITH c AS {CUSTOMER_GAPS}
SELECT 'c_nationkey' AS "column", COUNT(DISTINCT c_nationkey) AS n_distinct FROM c
UNION ALL SELECT 'c_mktsegment', COUNT(DISTINCT c_mktsegment) FROM c
UNION ALL SELECT 'c_acctbal', COUNT(DISTINCT c_acctbal) FROM c
UNION ALL SELECT 'bal', COUNT(DISTINCT bal) + MAX(CASE WHEN bal IS NULL THEN 1 ELSE 0 END) FROM c""")
def a8(spark, sf):
    return agg.cardinality(customer_gaps(spark, sf), ["c_nationkey", "c_mktsegment", "c_acctbal", "bal"])


@query("a8_binary_columns", """
SELECT 'quality' AS "column", COUNT(*) AS n, CAST(SUM(quality) AS BIGINT) AS hits FROM labels
UNION ALL SELECT 'toxic', COUNT(*), CAST(SUM(toxic) AS BIGINT) FROM labels""")
def a8b(spark, sf):
    labels = table(spark, sf, "labels")
    long = labels.unpivot(["doc_id"], agg.binary_columns(labels), "column", "v")
    return long.groupBy("column").agg(F.count("v").alias("n"), F.sum("v").cast("bigint").alias("hits"))


@query("a9_calendar", """
SELECT CAST(UNNEST(generate_series((SELECT MIN(CAST(o_orderdate AS DATE)) FROM orders),
       (SELECT MAX(CAST(o_orderdate AS DATE)) FROM orders), INTERVAL 1 DAY)) AS DATE) AS day""")
def a9(spark, sf):
    return calendars.calendar_of(table(spark, sf, "orders"), "o_orderdate", "day")


@query("a10_day_types", """
SELECT d AS date, CASE WHEN isodow(d) >= 6 THEN 'Holiday' ELSE 'Workday' END AS day_type, 'Ordinary' AS locale
FROM (SELECT CAST(UNNEST(generate_series((SELECT MIN(CAST(o_orderdate AS DATE)) FROM orders),
       (SELECT MAX(CAST(o_orderdate AS DATE)) FROM orders), INTERVAL 1 DAY)) AS DATE) AS d)""")
def a10(spark, sf):
    return calendars.day_type_calendar(calendars.calendar_of(table(spark, sf, "orders"), "o_orderdate"))


@query("a11_grid_scan", """
SELECT k.min_price, k.max_size, COUNT(p_partkey) AS n
FROM (SELECT * FROM (VALUES (900.0), (1000.0), (1500.0)) a(min_price), (VALUES (10), (30)) b(max_size)) k
LEFT JOIN part ON p_retailprice >= min_price AND p_size <= max_size GROUP BY 1, 2""")
def a11(spark, sf):
    grid = calendars.param_grid(min_price=[900.0, 1000.0, 1500.0], max_size=[10, 30])
    hits = table(spark, sf, "part").agg(F.array(*[
        F.struct(F.lit(p["min_price"]).alias("min_price"), F.lit(p["max_size"]).alias("max_size"),
                 F.count_if((F.col("p_retailprice") >= p["min_price"]) & (F.col("p_size") <= p["max_size"])).alias("n"))
        for p in grid]).alias("a"))
    return hits.select(F.explode("a").alias("x")).select("x.*")


@query("a12_write_read", """
SELECT o_orderpriority, COUNT(*) AS n, round(SUM(o_totalprice), 2) AS total FROM orders GROUP BY 1""")
def a12(spark, sf):
    path = sinks.write_table(table(spark, sf, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice"),
                             workspace.new_path(spark, "sink"))
    schema = T.StructType([T.StructField("o_orderpriority", T.StringType()), T.StructField("o_totalprice", T.DoubleType())])
    back = readers.read_table(spark, path, schema=schema)
    return back.groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"), r4(F.sum("o_totalprice"), 2).alias("total"))


@query("a13_submission", """
SELECT o_orderkey AS id, greatest(0.0, round_even(exp(ln(1 + o_totalprice)) - 1, -2)) AS price FROM orders""")
def a13(spark, sf):
    pred = table(spark, sf, "orders").select("o_orderkey", F.log1p("o_totalprice").alias("prediction"))
    return sinks.submission(pred, "o_orderkey", "prediction", "price", "expm1", -2, 0.0, "id")


# ---- projections


@query("b1_relocate", "SELECT o_totalprice, o_orderkey, o_custkey, o_orderpriority FROM orders")
def b1(spark, sf):
    df = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority")
    return columns.relocate(df, ["o_totalprice"])


@query("b2_conform", "SELECT c_custkey, CAST(NULL AS VARCHAR) AS c_phone, c_mktsegment FROM customer")
def b2(spark, sf):
    out = columns.conform(table(spark, sf, "customer"), ["c_custkey", "c_phone", "c_mktsegment"])
    return out.withColumn("c_phone", F.col("c_phone").cast("string"))


@query("b4_rename", "SELECT n_nationkey AS nation, n_name AS name FROM nation")
def b4(spark, sf):
    return table(spark, sf, "nation").drop("n_regionkey").withColumnsRenamed({"n_nationkey": "nation", "n_name": "name"})


@query("b5_rename_by_type", """
SELECT p_partkey AS "bin-01", p_brand AS "cat-01", p_name AS "cat-02", p_type AS "cat-03", p_size AS "bin-02",
       p_retailprice AS target FROM part""")
def b5(spark, sf):
    return columns.rename_by_type(table(spark, sf, "part"), "p_retailprice")


@query("b7_across", """
SELECT l_returnflag, round(SUM(round_even(l_extendedprice, 0)), 2) AS price, round(SUM(round_even(l_discount, 0)), 2) AS discount,
       round(SUM(round_even(l_quantity, 0)), 2) AS quantity FROM lineitem GROUP BY 1""")
def b7(spark, sf):
    df = table(spark, sf, "lineitem").select("l_returnflag", "l_quantity", "l_extendedprice", "l_discount")
    whole = columns.across(df, columns.columns_of(df, "numeric"), S.round_even)
    return whole.groupBy("l_returnflag").agg(
        r4(F.sum("l_extendedprice"), 2).alias("price"), r4(F.sum("l_discount"), 2).alias("discount"),
        r4(F.sum("l_quantity"), 2).alias("quantity"))


@query("b8_convert_types", """
SELECT l_returnflag, CAST(SUM(CAST(trunc(l_extendedprice) AS BIGINT)) AS BIGINT) AS price, COUNT(DISTINCT CAST(l_linenumber AS VARCHAR)) AS line_levels,
       CAST(SUM(CAST(trunc(l_quantity) AS BIGINT)) AS BIGINT) AS quantity FROM lineitem GROUP BY 1""")
def b8(spark, sf):
    text = table(spark, sf, "lineitem").select(
        "l_returnflag", "l_linenumber", F.col("l_extendedprice").cast("string"), "l_quantity")
    typed = columns.convert_types(text, to_long=["l_extendedprice", "l_quantity"], to_category=["l_linenumber"])
    return typed.groupBy("l_returnflag").agg(
        F.sum("l_extendedprice").alias("price"), F.count_distinct("l_linenumber").alias("line_levels"),
        F.sum("l_quantity").alias("quantity"))


@query("b9_add_column", "SELECT s_suppkey, 'supplier' AS source, s_name, s_nationkey, s_acctbal FROM supplier")
def b9(spark, sf):
    return columns.add_column(table(spark, sf, "supplier"), "source", F.lit("supplier"), "s_suppkey")


@query("b10_update_where", """
SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 0.0 ELSE o_totalprice END AS o_totalprice FROM orders""")
def b10(spark, sf):
    out = columns.update_where(table(spark, sf, "orders"), F.col("o_orderstatus") == "P", "o_totalprice", 0.0)
    return out.select("o_orderkey", "o_totalprice")


@query("b11_ratio", """
SELECT l_suppkey, round(SUM(l_extendedprice) / NULLIF(SUM(l_quantity), 0), 4) AS unit_price,
       round(SUM(l_extendedprice + l_tax), 2) AS total FROM lineitem GROUP BY 1""")
def b11(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_suppkey").agg(
        r4(S.safe_divide(F.sum("l_extendedprice"), F.sum("l_quantity"))).alias("unit_price"),
        r4(F.sum(F.col("l_extendedprice") + F.col("l_tax")), 2).alias("total"))


@query("b12_tag_ids", """
SELECT c_custkey || '_cust' AS tagged, c_custkey AS id FROM customer
UNION ALL SELECT s_suppkey || '_supp', s_suppkey FROM supplier""")
def b12(spark, sf):
    both = columns.tag_id(table(spark, sf, "customer").select(F.col("c_custkey").alias("id")), "id", "cust").unionByName(
        columns.tag_id(table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id")), "id", "supp"))
    return columns.untag_id(both.withColumn("tagged", F.col("id")), "id")


# ---- filters and row selection


@query("c1_filter", f"WITH c AS {CUSTOMER_GAPS} SELECT c_custkey, bal FROM c WHERE bal > 5000")
def c1(spark, sf):
    return customer_gaps(spark, sf).filter(F.col("bal") > 5000).select("c_custkey", "bal")


@query("c2_member", "SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')")
def c2(spark, sf):
    return table(spark, sf, "orders").filter(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")).select(
        "o_orderkey", "o_orderpriority")


@query("c3_not_member", """
SELECT p_partkey, p_brand FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity >= 49)""")
def c3(spark, sf):
    big = table(spark, sf, "lineitem").filter("l_quantity >= 49").select(F.col("l_partkey").alias("p_partkey"))
    return table(spark, sf, "part").join(big, "p_partkey", "left_anti").select("p_partkey", "p_brand")


@query("c4_drop_na", f"WITH c AS {CUSTOMER_GAPS} SELECT c_custkey, bal FROM c WHERE bal IS NOT NULL")
def c4(spark, sf):
    return rows.drop_na(customer_gaps(spark, sf)).select("c_custkey", "bal")


@query("c5_date_range", """
SELECT o_orderkey FROM orders WHERE o_orderdate >= TIMESTAMP '1997-01-01' AND o_orderdate < TIMESTAMP '1998-01-01'""")
def c5(spark, sf):
    return table(spark, sf, "orders").filter(
        (F.col("o_orderdate") >= F.lit("1997-01-01").cast("timestamp"))
        & (F.col("o_orderdate") < F.lit("1998-01-01").cast("timestamp"))).select("o_orderkey")


@query("c6_split", f"""
WITH c AS {CUSTOMER_GAPS}
SELECT 'yes' AS side, COUNT(*) AS n, round(SUM(bal), 2) AS total FROM c WHERE bal > 0
UNION ALL SELECT 'no', COUNT(*), round(SUM(bal), 2) FROM c WHERE NOT bal > 0""")
def c6(spark, sf):
    yes, no = rows.split_by(customer_gaps(spark, sf), F.col("bal") > 0)
    return agg.union_all([
        side.agg(F.count(F.lit(1)).alias("n"), r4(F.sum("bal"), 2).alias("total")).select(
            F.lit(name).alias("side"), "n", "total") for name, side in (("yes", yes), ("no", no))])


@query("c7_slice", """
SELECT o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders)
WHERE r BETWEEN 101 AND 600""")
def c7(spark, sf):
    return rows.slice_rows(table(spark, sf, "orders").select("o_orderkey", "o_totalprice"),
                           [F.desc("o_totalprice"), "o_orderkey"], 101, 600)


@query("c8_drop_positions", """
SELECT p_partkey, p_retailprice FROM (SELECT *, row_number() OVER (ORDER BY p_retailprice DESC, p_partkey) AS r FROM part)
WHERE r NOT IN (1, 2, 5, 100)""")
def c8(spark, sf):
    return rows.drop_positions(table(spark, sf, "part").select("p_partkey", "p_retailprice"),
                               [F.desc("p_retailprice"), "p_partkey"], [1, 2, 5, 100])


@query("c9_keep_frequent", """
SELECT p_partkey, p_brand FROM part WHERE p_brand IN (SELECT p_brand FROM part GROUP BY 1 HAVING COUNT(*) >=
    (SELECT COUNT(*) / 25.0 FROM part))""")
def c9(spark, sf):
    part = table(spark, sf, "part").select("p_partkey", "p_brand")
    return rows.keep_frequent(part, "p_brand", -(-part.count() // 25))


@query("c10_drop_sparse", f"WITH c AS {CUSTOMER_GAPS} SELECT c_custkey, c_name, c_mktsegment FROM c")
def c10(spark, sf):
    df = customer_gaps(spark, sf).select("c_custkey", "c_name", "c_mktsegment", "bal")
    return rows.drop_sparse_columns(df, 0.1)


@query("c11_sample_entities", f"""
WITH u AS (SELECT DISTINCT o_custkey FROM orders), s AS (SELECT o_custkey FROM u ORDER BY {hash_sql('o_custkey', 11)}, o_custkey LIMIT 60)
SELECT CASE WHEN s.o_custkey IS NULL THEN 'rest' ELSE 'sample' END AS side, COUNT(*) AS n, COUNT(DISTINCT o.o_custkey) AS users,
       round(SUM(o_totalprice), 2) AS total FROM orders o LEFT JOIN s ON s.o_custkey = o.o_custkey GROUP BY 1""")
def c11(spark, sf):
    sample, rest = rows.sample_split(table(spark, sf, "orders"), "o_custkey", 60, 11)
    return agg.union_all([
        df.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("o_custkey").alias("users"),
               r4(F.sum("o_totalprice"), 2).alias("total")).select(F.lit(side).alias("side"), "n", "users", "total")
        for side, df in (("sample", sample), ("rest", rest))])


@query("c12_train_test", f"""
SELECT o_orderkey, CASE WHEN {unit_sql('o_orderkey', 5)} < 0.8 THEN 'train' ELSE 'test' END AS side FROM orders""")
def c12(spark, sf):
    train, test = rows.train_test_split(table(spark, sf, "orders").select("o_orderkey"), "o_orderkey", 0.8, 5)
    return agg.tag_union(train, test, "side")


@query("c13_folds", f"SELECT o_orderkey, CAST(floor({unit_sql('o_orderkey', 3)} * 10) AS INTEGER) AS fold FROM orders")
def c13(spark, sf):
    return rows.kfold(table(spark, sf, "orders").select("o_orderkey"), "o_orderkey", 10, 3)


@query("c14_sample_per_group", f"""
SELECT o_custkey, o_orderkey FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey
    ORDER BY {hash_sql('o_orderkey', 9)}, o_orderkey) AS r FROM orders) WHERE r <= 3""")
def c14(spark, sf):
    return rows.sample_per_group(table(spark, sf, "orders").select("o_custkey", "o_orderkey"), ["o_custkey"],
                                 "o_orderkey", 3, 9)


# ---- joins


@query("d1_left_join", "SELECT n_name, r_name FROM nation LEFT JOIN region ON n_regionkey = r_regionkey + 1")
def d1(spark, sf):
    region = table(spark, sf, "region").select((F.col("r_regionkey") + 1).alias("n_regionkey"), "r_name")
    return table(spark, sf, "nation").join(region, "n_regionkey", "left").select("n_name", "r_name")


@query("d2_composite_join", """
SELECT o_orderkey, c.n AS customers FROM (SELECT o_orderkey, c_nationkey, c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey) o
LEFT JOIN (SELECT c_nationkey, c_mktsegment, COUNT(*) AS n FROM customer WHERE c_acctbal > 0 GROUP BY 1, 2) c
  ON c.c_nationkey = o.c_nationkey AND c.c_mktsegment = o.c_mktsegment""")
def d2(spark, sf):
    customer = table(spark, sf, "customer")
    peers = customer.filter("c_acctbal > 0").groupBy("c_nationkey", "c_mktsegment").agg(F.count(F.lit(1)).alias("customers"))
    o = table(spark, sf, "orders").join(customer, F.col("o_custkey") == F.col("c_custkey"))
    return o.join(peers, ["c_nationkey", "c_mktsegment"], "left").select("o_orderkey", "customers")


@query("d3_fan_out_join", """
SELECT o_orderkey, o_orderpriority, l_partkey, l_quantity FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey""")
def d3(spark, sf):
    lines = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_partkey", "l_quantity")
    return table(spark, sf, "orders").select("o_orderkey", "o_orderpriority").join(lines, "o_orderkey", "left")


@query("d4_fold_join", """
WITH a AS (SELECT CAST(o_orderdate AS DATE) AS d, COUNT(*) AS orders FROM orders GROUP BY 1),
b AS (SELECT CAST(l_shipdate AS DATE) AS d, COUNT(*) AS shipped FROM lineitem GROUP BY 1),
c AS (SELECT CAST(ts AS DATE) AS d, COUNT(*) AS events FROM events GROUP BY 1)
SELECT a.d, orders, shipped, events FROM a LEFT JOIN b ON a.d = b.d LEFT JOIN c ON a.d = c.d""")
def d4(spark, sf):
    def per_day(name, col, out):
        return table(spark, sf, name).groupBy(F.to_date(col).alias("d")).agg(F.count(F.lit(1)).alias(out))
    return joins.left_join_all([per_day("orders", "o_orderdate", "orders"), per_day("lineitem", "l_shipdate", "shipped"),
                                per_day("events", "ts", "events")], "d")


@query("d5_join_coalesce", """
SELECT c_custkey, COALESCE(l.last_status, 'none') AS status, c_mktsegment
FROM customer LEFT JOIN (SELECT o_custkey, MAX(o_orderstatus) AS last_status FROM orders WHERE o_totalprice > 300000 GROUP BY 1) l
ON c_custkey = o_custkey""")
def d5(spark, sf):
    base = table(spark, sf, "customer").select("c_custkey", F.lit("none").alias("status"), "c_mktsegment")
    new = table(spark, sf, "orders").filter("o_totalprice > 300000").groupBy(
        F.col("o_custkey").alias("c_custkey")).agg(F.max("o_orderstatus").alias("status"))
    return joins.join_coalesce(base, new, "c_custkey", ["status"])


@query("d6_star_join", """
SELECT r_name, n_name, p_type, CAST(YEAR(o_orderdate) AS INTEGER) AS year, COUNT(*) AS n, round(SUM(l_extendedprice * (1 - l_discount)), 4) AS revenue
FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey LEFT JOIN customer ON o_custkey = c_custkey
LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey LEFT JOIN part ON l_partkey = p_partkey
GROUP BY 1, 2, 3, 4""")
def d6(spark, sf):
    place = table(spark, sf, "nation").join(
        table(spark, sf, "region").withColumnRenamed("r_regionkey", "n_regionkey"), "n_regionkey", "left").select(
        F.col("n_nationkey").alias("c_nationkey"), "n_name", "r_name")
    customer = table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey")
    orders = table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey",
                                               F.year("o_orderdate").alias("year"))
    part = table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), "p_type")
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_extendedprice", "l_discount")
    full = joins.enrich(lines, [(orders, "l_orderkey"), (customer, "o_custkey"), (place, "c_nationkey"), (part, "l_partkey")])
    return full.groupBy("r_name", "n_name", "p_type", "year").agg(
        F.count(F.lit(1)).alias("n"), r4(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount")))).alias("revenue"))


@query("d7_align_to_spine", f"WITH {DAILY_CTE} SELECT k.prio, s.d, f.qty FROM (SELECT DISTINCT prio FROM facts) k CROSS JOIN spine s "
       "LEFT JOIN facts f ON f.prio = k.prio AND f.d = s.d")
def d7(spark, sf):
    spine = calendars.calendar_of(table(spark, sf, "orders"), "o_orderdate", "d")
    return joins.align_to_spine(daily_facts(spark, sf), spine, "d", ["prio"])


@query("d8_semi_join", """
SELECT DISTINCT CAST(l_shipdate AS DATE) AS d FROM lineitem WHERE CAST(l_shipdate AS DATE) IN (SELECT CAST(o_orderdate AS DATE) FROM orders)""")
def d8(spark, sf):
    days = table(spark, sf, "orders").select(F.to_date("o_orderdate").alias("d"))
    return table(spark, sf, "lineitem").select(F.to_date("l_shipdate").alias("d")).join(days, "d", "left_semi").distinct()


@query("d9_anti_join", """
SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)""")
def d9(spark, sf):
    big = table(spark, sf, "orders").filter("o_totalprice > 400000").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf, "customer").select("c_custkey").join(big, "c_custkey", "left_anti")


@query("d10_any_match", """
WITH w AS (SELECT DISTINCT p_partkey, UNNEST(string_split(p_name, ' ')) AS word FROM part)
SELECT a.p_partkey, COUNT(DISTINCT b.p_partkey) AS matches FROM w a JOIN w b ON a.word = b.word GROUP BY 1""")
def d10(spark, sf):
    part = table(spark, sf, "part").select("p_partkey", F.array_sort(F.array_distinct(F.split("p_name", " "))).alias("words"))
    sizes = part.groupBy(F.col("words").alias("right_set")).agg(F.count(F.lit(1)).alias("n"))
    pairs = joins.any_match(part, part, "words", "words")
    hits = pairs.join(sizes, "right_set").groupBy(F.col("left_set").alias("words")).agg(F.sum("n").alias("matches"))
    return part.join(hits, "words").select("p_partkey", "matches")


@query("d11_band_join", """
SELECT a.p_partkey, COUNT(*) AS near FROM part a JOIN part b ON a.p_type = b.p_type AND abs(a.p_size - b.p_size) <= 4 GROUP BY 1""")
def d11(spark, sf):
    part = table(spark, sf, "part").select("p_partkey", "p_type", "p_size")
    sizes = part.groupBy("p_type", "p_size").agg(F.count(F.lit(1)).alias("n"))
    return joins.band_join(part, sizes, ["p_type"], "p_size", 4).groupBy("p_partkey").agg(F.sum("n_r").alias("near"))


@query("d12_join_on_order", """
SELECT a.c_custkey, b.p_partkey FROM (SELECT c_custkey, row_number() OVER (ORDER BY c_acctbal, c_custkey) AS r FROM customer) a
JOIN (SELECT p_partkey, row_number() OVER (ORDER BY p_retailprice, p_partkey) AS r FROM part) b ON a.r = b.r""")
def d12(spark, sf):
    return joins.join_on_order(
        table(spark, sf, "customer").select("c_custkey", "c_acctbal"), table(spark, sf, "part").select("p_partkey", "p_retailprice"),
        ["c_acctbal", "c_custkey"], ["p_retailprice", "p_partkey"]).select("c_custkey", "p_partkey")


@query("d13_backfill", f"""
WITH c AS {CUSTOMER_GAPS}, p AS (SELECT o_custkey, MAX(o_totalprice) AS v FROM orders GROUP BY 1)
SELECT c_custkey, COALESCE(bal, v) AS bal FROM c LEFT JOIN p ON c_custkey = o_custkey""")
def d13(spark, sf):
    pred = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        F.max("o_totalprice").alias("prediction"))
    return joins.backfill(customer_gaps(spark, sf).select("c_custkey", "bal"), pred, "c_custkey", "bal")


# ---- sets


_TRAIN, _TEST = "p_partkey % 5 <> 0", "p_partkey % 5 = 0"


@query("h1_tag_union", f"""
SELECT p_partkey, p_retailprice, 'train' AS data_type FROM part WHERE {_TRAIN}
UNION ALL SELECT p_partkey, NULL, 'test' FROM part WHERE {_TEST}""")
def h1(spark, sf):
    part = table(spark, sf, "part").select("p_partkey", "p_retailprice")
    return agg.tag_union(part.filter(_TRAIN), part.filter(_TEST).drop("p_retailprice"))


@query("h2_union_all", """
SELECT c_nationkey AS nation, c_acctbal AS bal FROM customer UNION ALL SELECT s_nationkey, s_acctbal FROM supplier""")
def h2(spark, sf):
    return agg.union_all([
        table(spark, sf, "customer").select(F.col("c_nationkey").alias("nation"), F.col("c_acctbal").alias("bal")),
        table(spark, sf, "supplier").select(F.col("s_acctbal").alias("bal"), F.col("s_nationkey").alias("nation"))])


@query("h5_level_drift", """
WITH a AS (SELECT DISTINCT 'p_name' AS "column", p_name AS level FROM part WHERE p_partkey % 5 <> 0
    UNION SELECT DISTINCT 'p_size', CAST(p_size AS VARCHAR) FROM part WHERE p_partkey % 5 <> 0 AND p_size < 45),
b AS (SELECT DISTINCT 'p_name' AS "column", p_name AS level FROM part WHERE p_partkey % 5 = 0
    UNION SELECT DISTINCT 'p_size', CAST(p_size AS VARCHAR) FROM part WHERE p_partkey % 5 = 0)
SELECT "column", level, 'train' AS only_in FROM (SELECT * FROM a EXCEPT SELECT * FROM b)
UNION ALL SELECT "column", level, 'test' FROM (SELECT * FROM b EXCEPT SELECT * FROM a)""")
def h5(spark, sf):
    part = table(spark, sf, "part").select("p_partkey", "p_name", "p_size")
    train = part.filter(_TRAIN).withColumn("p_size", F.when(F.col("p_size") < 45, F.col("p_size")))
    return agg.level_drift(train, part.filter(_TEST), ["p_name", "p_size"])


@query("h6_entities_except", """
SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'F'""")
def h6(spark, sf):
    done = table(spark, sf, "orders").filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return agg.entities_except(table(spark, sf, "customer"), done, "c_custkey")


@query("h7_all_levels", "SELECT c_nationkey AS nation FROM customer UNION SELECT s_nationkey FROM supplier")
def h7(spark, sf):
    return agg.all_levels(table(spark, sf, "customer").select(F.col("c_nationkey").alias("nation")),
                          table(spark, sf, "supplier").select(F.col("s_nationkey").alias("nation")), "nation")


# ---- scalar functions


@query("i_maths", """
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, round(ln(1 + l_extendedprice), 4) AS logged, round(exp(ln(1 + l_quantity)) - 1, 4) AS back,
  round(exp(l_discount), 4) AS exp_discount, round_even(l_extendedprice, 0) AS r0, round_even(l_extendedprice, -2) AS r_2,
  floor(l_quantity / 15) * 15 AS bucket, greatest(0.0, 25 - l_quantity) AS clipped, round(sqrt(abs(l_quantity - 25)), 4) AS root,
  round(pow(l_quantity - 25, 2), 4) AS square, CAST(trunc(l_extendedprice) AS BIGINT) AS whole
FROM lineitem""")
def i_maths(spark, sf):
    q, p = F.col("l_quantity"), F.col("l_extendedprice")
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", r4(F.log1p(p)).alias("logged"), r4(F.expm1(F.log1p(q))).alias("back"),
        r4(F.exp("l_discount")).alias("exp_discount"), S.round_even(p).alias("r0"), S.round_even(p, -2).alias("r_2"),
        S.floor_bucket(q, 15).cast("double").alias("bucket"), S.clip_low(25 - q).alias("clipped"),
        r4(F.sqrt(F.abs(q - 25))).alias("root"), r4(F.pow(q - 25, F.lit(2))).alias("square"), p.cast("bigint").alias("whole"))


@query("i_centre", """
SELECT c_custkey, round(c_acctbal - (SELECT AVG(c_acctbal) FROM customer), 4) AS centred FROM customer""")
def i_centre(spark, sf):
    customer = table(spark, sf, "customer")
    return customer.select("c_custkey", r4(F.col("c_acctbal") - customer.agg(F.avg("c_acctbal")).scalar()).alias("centred"))


@query("i_text", """
SELECT p_partkey, lower(trim(p_type)) AS kind, string_split(p_name, ' ')[1] AS first_word,
  regexp_replace(p_brand, '[0-9]+', '', 'g') AS no_digits, regexp_replace(p_brand, '[!-/:-@\\[-`{-~]', '', 'g') AS no_marks,
  p_brand || ', ' || p_type AS joined, (contains(p_name, 'red') OR contains(p_name, 'ring')) AS hit,
  CAST(regexp_extract(p_brand, '([0-9]+)', 1) AS BIGINT) AS brand_no, replace(p_name, ' ', '_') AS label,
  starts_with(p_name, 'small') AS small FROM part""")
def i_text(spark, sf):
    return table(spark, sf, "part").select(
        "p_partkey", S.lower_trim(F.col("p_type")).alias("kind"), S.split_trim(F.col("p_name"), " ")[0].alias("first_word"),
        S.strip_digits(F.col("p_brand")).alias("no_digits"), S.strip_punctuation(F.col("p_brand")).alias("no_marks"),
        S.join_text("p_brand", "p_type").alias("joined"), S.contains_any(F.col("p_name"), ["red", "ring"]).alias("hit"),
        S.digits_of(F.col("p_brand")).alias("brand_no"), F.replace("p_name", F.lit(" "), F.lit("_")).alias("label"),
        F.col("p_name").startswith("small").alias("small"))


@query("i_dates", """
SELECT o_orderkey, dayname(o_orderdate) AS day_name, isodow(o_orderdate) >= 6 AS weekend, monthname(o_orderdate) AS month,
  CAST(year(o_orderdate) AS INTEGER) AS year, strftime(o_orderdate, '%Y-%m') AS yr_month, CAST(dayofyear(o_orderdate) AS INTEGER) AS yday,
  CAST(date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) AS INTEGER) AS days FROM orders""")
def i_dates(spark, sf):
    d = F.col("o_orderdate")
    return table(spark, sf, "orders").select(
        "o_orderkey", S.weekday_name(d).alias("day_name"), S.is_weekend(d).alias("weekend"), S.month_name(d).alias("month"),
        F.year(d).alias("year"), S.year_month(d).alias("yr_month"), F.dayofyear(d).alias("yday"),
        S.days_between(d, F.lit("1995-01-01").cast("date")).alias("days"))


@query("i_conditions", f"""
WITH c AS {CUSTOMER_GAPS}
SELECT c_custkey, CASE WHEN bal IS NULL THEN 'unknown' WHEN bal < 0 THEN 'debt' ELSE 'ok' END AS state, COALESCE(bal, 0.0) AS filled,
  COALESCE(bal, c_acctbal) AS first_known, CASE c_mktsegment WHEN 'BUILDING' THEN 'B' WHEN 'MACHINERY' THEN 'M' ELSE c_mktsegment END AS segment
FROM c""")
def i_conditions(spark, sf):
    return customer_gaps(spark, sf).select(
        "c_custkey", F.when(F.col("bal").isNull(), "unknown").when(F.col("bal") < 0, "debt").otherwise("ok").alias("state"),
        F.coalesce("bal", F.lit(0.0)).alias("filled"), F.coalesce("bal", "c_acctbal").alias("first_known"),
        S.recode(F.col("c_mktsegment"), {"BUILDING": "B", "MACHINERY": "M"}).alias("segment"))
