"""Imputation, outliers, encoding, scaling and statistics over the test tables."""

from __future__ import annotations

from pyspark.ml.feature import VectorAssembler
from pyspark.ml import Pipeline
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from tabkit.functions.numerics import normal_quantile_sql
from tabkit.operators import encode, impute, neighbors, outliers, stats
from tabkit.operators.order import with_position
from tabkit.plans.registry import CUSTOMER_GAPS, DAILY_CTE, customer_gaps, daily_panel, query, r4, table

# ---- missing values


@query("k1_median_impute", f"""
WITH c AS {CUSTOMER_GAPS} SELECT c_custkey, round(COALESCE(bal, (SELECT quantile_cont(bal, 0.5) FROM c)), 4) AS bal FROM c""")
def k1(spark, sf):
    return impute.impute(customer_gaps(spark, sf), ["bal"], "median").select("c_custkey", r4("bal").alias("bal"))


@query("k2_group_mean_impute", f"""
WITH c AS {CUSTOMER_GAPS} SELECT c_custkey, round(COALESCE(bal, AVG(bal) OVER (PARTITION BY c_mktsegment)), 4) AS bal FROM c""")
def k2(spark, sf):
    return impute.impute(customer_gaps(spark, sf), ["bal"], "mean", ["c_mktsegment"]).select("c_custkey", r4("bal").alias("bal"))


@query("k3_mode_impute", """
WITH c AS (SELECT c_custkey, CASE WHEN c_custkey % 7 <> 0 THEN c_mktsegment END AS seg FROM customer)
SELECT c_custkey, COALESCE(seg, (SELECT seg FROM c WHERE seg IS NOT NULL GROUP BY seg ORDER BY COUNT(*) DESC, seg LIMIT 1)) AS seg FROM c""")
def k3(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", F.when(F.col("c_custkey") % 7 != 0, F.col("c_mktsegment")).alias("seg"))
    return impute.impute(c, ["seg"], "mode")


@query("k4_knn_impute", """
WITH p AS (SELECT p_partkey, CASE WHEN p_partkey % 10 <> 3 THEN CAST(p_size AS DOUBLE) END AS size, p_retailprice AS price FROM part),
s AS (SELECT AVG(size) AS ms, stddev_samp(size) AS ss, AVG(price) AS mp, stddev_samp(price) AS sp FROM p),
n AS (SELECT q.p_partkey, b.size, sqrt(pow((q.price - mp) / sp - (b.price - mp) / sp, 2)) AS dist, row_number() OVER (PARTITION BY q.p_partkey
   ORDER BY sqrt(pow((q.price - mp) / sp - (b.price - mp) / sp, 2)), b.p_partkey) AS r
   FROM p q JOIN p b ON q.size IS NULL AND b.size IS NOT NULL, s)
SELECT p.p_partkey, round(COALESCE(p.size, f.v), 3) AS size FROM p LEFT JOIN (SELECT p_partkey, SUM(size * exp(-dist)) / SUM(exp(-dist)) AS v
   FROM n WHERE r <= 50 GROUP BY 1) f ON p.p_partkey = f.p_partkey""")
def k4(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", F.when(F.col("p_partkey") % 10 != 3, F.col("p_size").cast("double")).alias("size"),
                                        F.col("p_retailprice").alias("price"))
    return impute.knn_impute(p, "p_partkey", ["size", "price"], 50).select("p_partkey", r4("size", 3).alias("size"))


def _series_sql(select: str) -> str:
    return f"""WITH {DAILY_CTE}, placed AS (SELECT prio, d, qty, row_number() OVER (PARTITION BY prio ORDER BY d) AS x FROM panel),
knots AS (SELECT prio, x, qty AS y, lag(x, 1) OVER k AS xp1, lag(qty, 1) OVER k AS yp1, lag(x, 2) OVER k AS xp2, lag(qty, 2) OVER k AS yp2,
   lead(x, 1) OVER k AS xn1, lead(qty, 1) OVER k AS yn1, lead(x, 2) OVER k AS xn2, lead(qty, 2) OVER k AS yn2
   FROM placed WHERE qty IS NOT NULL WINDOW k AS (PARTITION BY prio ORDER BY x)),
parts AS (SELECT *, CAST(x - xp1 AS DOUBLE) AS ha, CAST(xn1 - x AS DOUBLE) AS hb, (y - yp1) / (x - xp1) AS da, (yn1 - y) / (xn1 - x) AS db,
   CAST(xn2 - xn1 AS DOUBLE) AS hn, (yn2 - yn1) / (xn2 - xn1) AS dn, CAST(xp1 - xp2 AS DOUBLE) AS hp, (yp1 - yp2) / (xp1 - xp2) AS dp FROM knots),
ends AS (SELECT *, ((2 * hb + hn) * db - hb * dn) / (hb + hn) AS e0, ((2 * ha + hp) * da - ha * dp) / (ha + hp) AS e1 FROM parts),
slopes AS (SELECT prio, x, y, CASE
   WHEN ha IS NULL AND hb IS NULL THEN 0.0
   WHEN ha IS NULL THEN CASE WHEN hn IS NULL THEN db WHEN sign(e0) <> sign(db) THEN 0.0 WHEN sign(db) <> sign(dn) AND abs(e0) > 3 * abs(db) THEN 3 * db ELSE e0 END
   WHEN hb IS NULL THEN CASE WHEN hp IS NULL THEN da WHEN sign(e1) <> sign(da) THEN 0.0 WHEN sign(da) <> sign(dp) AND abs(e1) > 3 * abs(da) THEN 3 * da ELSE e1 END
   WHEN da * db <= 0 THEN 0.0 ELSE (3 * hb + 3 * ha) / ((2 * hb + ha) / da + (hb + 2 * ha) / db) END AS m FROM ends),
near AS (SELECT p.prio, p.d, p.x, p.qty,
   last_value(s.x IGNORE NULLS) OVER b AS x0, last_value(s.y IGNORE NULLS) OVER b AS y0, last_value(s.m IGNORE NULLS) OVER b AS m0,
   first_value(s.x IGNORE NULLS) OVER a AS x1, first_value(s.y IGNORE NULLS) OVER a AS y1, first_value(s.m IGNORE NULLS) OVER a AS m1
   FROM placed p LEFT JOIN slopes s ON s.prio = p.prio AND s.x = p.x
   WINDOW b AS (PARTITION BY p.prio ORDER BY p.x ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
          a AS (PARTITION BY p.prio ORDER BY p.x ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
unit AS (SELECT *, CAST(x1 - x0 AS DOUBLE) AS h, (x - x0) / NULLIF(CAST(x1 - x0 AS DOUBLE), 0) AS t FROM near)
SELECT prio, d, {select} AS qty FROM unit"""


@query("k5_pchip", _series_sql("""round(COALESCE(qty, y0 * (1 + 2 * t) * (1 - t) * (1 - t) + h * m0 * t * (1 - t) * (1 - t)
  + y1 * t * t * (3 - 2 * t) + h * m1 * t * t * (t - 1), y1, y0), 5)"""))
def k5(spark, sf):
    out = impute.interpolate(daily_panel(spark, sf), ["prio"], ["d"], "qty", "pchip", split=False)
    return out.withColumn("qty", r4("qty", 5))


@query("k6_spline")
def k6(spark, sf):
    return impute.interpolate(daily_panel(spark, sf), ["prio"], ["d"], "qty", "spline", 2, split=False)


@query("k6_spline_cubic", f"""
WITH {DAILY_CTE}, placed AS (SELECT prio, d, CAST(row_number() OVER (PARTITION BY prio ORDER BY d) AS DOUBLE) / 97 AS x FROM panel)
SELECT prio, d, round(1 - 2 * x + 0.5 * x * x - 0.03 * x * x * x, 4) AS v FROM placed""")
def k6_cubic(spark, sf):
    """A spline through points of a cubic is that cubic, also past its ends."""
    placed = with_position(daily_panel(spark, sf).select("prio", "d"), ["d"], ["prio"], "at", split=False).withColumn("x", F.col("at") / 97)
    x = F.col("x")
    known = placed.withColumn("v", F.when((F.col("at") % 3 != 0) & (F.col("at") > 2), 1 - 2 * x + 0.5 * x * x - 0.03 * x * x * x))
    return impute.interpolate(known, ["prio"], ["d"], "v", "spline", split=False).select("prio", "d", r4("v").alias("v"))


@query("k7_linear", _series_sql("round(COALESCE(qty, y0 + (y1 - y0) * t, y1, y0), 6)"))
def k7(spark, sf):
    out = impute.interpolate(daily_panel(spark, sf), ["prio"], ["d"], "qty", "linear", split=False)
    return out.withColumn("qty", r4("qty", 6))


@query("k8_zero_when_no_sales", f"""
WITH {DAILY_CTE}, z AS (SELECT k.prio, s.d, COALESCE(f.qty, 0) AS sales, CASE WHEN f.qty > 50 THEN f.qty / 10 END AS visits
  FROM (SELECT DISTINCT prio FROM facts) k CROSS JOIN spine s LEFT JOIN facts f ON f.prio = k.prio AND f.d = s.d)
SELECT prio, d, sales, CASE WHEN sales = 0 AND visits IS NULL THEN 0 ELSE visits END AS visits FROM z""")
def k8(spark, sf):
    from tabkit.operators.columns import update_where
    from tabkit.operators.joins import align_to_spine
    from tabkit.plans.registry import daily_facts
    from tabkit.sources.calendars import calendar_of

    spine = calendar_of(table(spark, sf, "orders"), "o_orderdate", "d")
    z = align_to_spine(daily_facts(spark, sf), spine, "d", ["prio"]).select(
        "prio", "d", F.coalesce("qty", F.lit(0.0)).alias("sales"), F.when(F.col("qty") > 50, F.col("qty") / 10).alias("visits"))
    return update_where(z, (F.col("sales") == 0) & F.col("visits").isNull(), "visits", 0.0)


@query("k9_impute_by_model")
def k9(spark, sf):
    orders = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("o_totalprice").alias("spent"))
    c = customer_gaps(spark, sf).join(orders, "c_custkey", "left").fillna(0, ["n", "spent"])
    est = Pipeline(stages=[VectorAssembler(inputCols=["n", "spent", "c_nationkey"], outputCol="features"),
                           LinearRegression(solver="normal")])
    return impute.impute_by_model(c, "c_custkey", "bal", est).select("c_custkey", r4("bal").alias("bal"))


@query("k10_chained_impute")
def k10(spark, sf):
    p = table(spark, sf, "part").select(
        "p_partkey", F.when(F.col("p_partkey") % 7 != 0, F.col("p_size").cast("double")).alias("size"),
        F.when(F.col("p_partkey") % 11 != 0, F.col("p_retailprice")).alias("price"))
    return impute.chained_impute(p, "p_partkey", ["size", "price"], m=2, iters=2)


# ---- outliers


@query("k11_flag_outliers", """
SELECT event_id, abs(value - AVG(value) OVER w) / stddev_samp(value) OVER w > 3 AS value_outlier FROM events WINDOW w AS (PARTITION BY event_type)""")
def k11(spark, sf):
    return outliers.flag_outliers(table(spark, sf, "events"), ["value"], by=["event_type"]).select("event_id", "value_outlier")


@query("k12_replace_outliers", """
SELECT event_id, round(CASE WHEN abs(value - m) / s > 3 THEN med ELSE value END, 4) AS value FROM events JOIN (SELECT event_type AS t, AVG(value) AS m,
  stddev_samp(value) AS s, quantile_cont(value, 0.5) AS med FROM events GROUP BY 1) ON t = event_type""")
def k12(spark, sf):
    out = outliers.replace_outliers(table(spark, sf, "events"), ["value"], ["event_type"])
    return out.select("event_id", r4("value").alias("value"))


@query("k13_iqr_filter", """
WITH q AS (SELECT quantile_cont(value, 0.25) AS lo, quantile_cont(value, 0.75) AS hi FROM events)
SELECT event_id, value FROM events, q WHERE value BETWEEN lo - 1.5 * (hi - lo) AND hi + 1.5 * (hi - lo)""")
def k13(spark, sf):
    return outliers.iqr_filter(table(spark, sf, "events"), "value").select("event_id", "value")


_LINE = """s AS (SELECT COUNT(*) AS n, AVG(l_quantity) AS mx, regr_sxx(l_extendedprice, l_quantity) AS sxx, regr_slope(l_extendedprice, l_quantity) AS b,
  regr_intercept(l_extendedprice, l_quantity) AS a FROM lineitem),
e AS (SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice - a - b * l_quantity AS e, 1.0 / n + pow(l_quantity - mx, 2) / sxx AS h, n FROM lineitem, s),
v AS (SELECT sqrt(SUM(e * e) / (any_value(n) - 2)) AS sd FROM e),
r AS (SELECT e.*, e / (sd * sqrt(1 - h)) AS r FROM e, v)"""


@query("k14_studentized", f"""
WITH {_LINE} SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, round(r * sqrt((n - 3) / (n - 2 - r * r)), 3) AS rstudent FROM r""")
def k14(spark, sf):
    df = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice")
    out = stats.influence(stats.ols(df, "l_extendedprice", ["l_quantity"]), df)
    return out.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", r4("rstudent", 3).alias("rstudent"))


@query("k14_outlier_test")
def k14b(spark, sf):
    df = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_tax", "l_extendedprice")
    return stats.outlier_test(stats.ols(df, "l_extendedprice", ["l_quantity", "l_tax"]), df)


@query("k15_influence", f"""
WITH {_LINE} SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, round(1e6 * h, 3) AS hat, round(1e6 * r * r * h / (2 * (1 - h)), 3) AS cook FROM r""")
def k15(spark, sf):
    df = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice")
    out = stats.influence(stats.ols(df, "l_extendedprice", ["l_quantity"]), df)
    return out.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", r4(F.col("hat") * 1e6, 3).alias("hat"),
                      r4(F.col("cook") * 1e6, 3).alias("cook"))


_TRAIN, _TEST = "p_partkey % 5 <> 0", "p_partkey % 5 = 0"


@query("k16_lump_rare", f"""
WITH keep AS (SELECT p_brand FROM part WHERE {_TRAIN} GROUP BY 1 HAVING COUNT(*) * 100.0 / (SELECT COUNT(*) FROM part WHERE {_TRAIN}) >= 4.0)
SELECT p_partkey, CASE WHEN p_brand IN (SELECT p_brand FROM keep) THEN p_brand ELSE 'Other' END AS p_brand FROM part""")
def k16(spark, sf):
    part = table(spark, sf, "part").select("p_partkey", "p_brand")
    return encode.lump_rare(part.filter(_TRAIN), "p_brand", 0.04).apply(part)


@query("k17_align_levels", f"""
WITH seen AS (SELECT DISTINCT p_name FROM part WHERE {_TRAIN} AND p_size > 20), m AS (SELECT p_name FROM part WHERE {_TRAIN} AND p_size > 20 GROUP BY 1 ORDER BY COUNT(*) DESC, p_name LIMIT 1)
SELECT p_partkey, CASE WHEN p_name IN (SELECT p_name FROM seen) THEN p_name ELSE (SELECT p_name FROM m) END AS p_name FROM part WHERE {_TEST}""")
def k17(spark, sf):
    part = table(spark, sf, "part").select("p_partkey", "p_name", "p_size")
    out = encode.align_levels(part.filter(_TRAIN).filter("p_size > 20"), part.filter(_TEST), "p_name")
    return out.select("p_partkey", "p_name")


# ---- nearest neighbours


@query("d14_knn_join", """
WITH v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings)
SELECT vec_id, neighbor, rank, distance FROM (SELECT a.vec_id, b.vec_id AS neighbor, round(list_distance(a.x, b.x), 4) AS distance,
  CAST(row_number() OVER (PARTITION BY a.vec_id ORDER BY list_distance(a.x, b.x), b.vec_id) AS INTEGER) AS rank FROM v a JOIN v b ON a.vec_id <> b.vec_id) WHERE rank <= 5""")
def d14(spark, sf):
    v = table(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("x"))
    out = neighbors.knn_join(v, v.withColumnRenamed("vec_id", "neighbor"), "vec_id", "neighbor", "x", 5, exclude_same=True)
    return out.withColumn("distance", r4("distance"))


# ---- encoding and scaling


@query("l1_label_encode", """
SELECT o_orderkey, CAST(dense_rank() OVER (ORDER BY o_orderpriority) - 1 AS INTEGER) AS code FROM orders""")
def l1(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority")
    return encode.label_encoder(orders, "o_orderpriority", "code").apply(orders).select("o_orderkey", "code")


@query("l2_binary_encode", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END AS l_linestatus FROM lineitem")
def l2(spark, sf):
    df = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_linestatus")
    return encode.binary_encode(df, {"l_linestatus": "O"})


_OTRAIN = "o_orderkey % 5 <> 0"


@query("l3_standard_scaler", f"""
WITH s AS (SELECT AVG(o_totalprice) AS m, stddev_pop(o_totalprice) AS sd FROM orders WHERE {_OTRAIN})
SELECT o_orderkey, round((o_totalprice - m) / sd, 5) AS z FROM orders, s""")
def l3(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    out = encode.standard_scaler(orders.filter(_OTRAIN), ["o_totalprice"]).apply(orders)
    return out.select("o_orderkey", r4("o_totalprice", 5).alias("z"))


@query("l4_robust_scaler", f"""
WITH s AS (SELECT quantile_cont(o_totalprice, 0.5) AS m, quantile_cont(o_totalprice, 0.75) - quantile_cont(o_totalprice, 0.25) AS iqr FROM orders WHERE {_OTRAIN})
SELECT o_orderkey, round((o_totalprice - m) / iqr, 5) AS z FROM orders, s""")
def l4(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    out = encode.robust_scaler(orders.filter(_OTRAIN), ["o_totalprice"]).apply(orders)
    return out.select("o_orderkey", r4("o_totalprice", 5).alias("z"))


@query("l5_box_cox", """
WITH grid AS (SELECT CAST(i AS DOUBLE) / 10.0 AS lam FROM (SELECT UNNEST(range(-20, 21)) AS i)), x AS (SELECT event_id, value + 1 AS x FROM events),
l AS (SELECT lam, (lam - 1) * SUM(ln(x)) - COUNT(*) / 2.0 * ln(var_pop(CASE WHEN lam = 0 THEN ln(x) ELSE (pow(x, lam) - 1) / NULLIF(lam, 0) END)) AS llf FROM x, grid GROUP BY lam),
b AS (SELECT lam FROM l ORDER BY llf DESC LIMIT 1)
SELECT event_id, round(CASE WHEN lam = 0 THEN ln(x) ELSE (pow(x, lam) - 1) / NULLIF(lam, 0) END, 5) AS value FROM x, b""")
def l5(spark, sf):
    out = encode.box_cox(table(spark, sf, "events").select("event_id", "value"), ["value"], refine=0)
    return out.withColumn("value", r4("value", 5))


@query("l6_james_stein", f"""
WITH p AS (SELECT AVG(o_totalprice) AS m, var_samp(o_totalprice) AS v FROM orders WHERE {_OTRAIN}),
g AS (SELECT o_custkey, AVG(o_totalprice) AS gm, COALESCE(var_samp(o_totalprice), 0) AS gv FROM orders WHERE {_OTRAIN} GROUP BY 1),
k AS (SELECT COUNT(*) AS k FROM g), e AS (SELECT o_custkey, greatest(0.0, least(1.0, 1.0 - gv / (gv + v) * ((k - 3.0) / (k - 1.0)))) AS s, gm, m FROM g, p, k)
SELECT o_orderkey, round(COALESCE(s * gm + (1.0 - s) * e.m, p.m), 3) AS o_custkey_js FROM orders o LEFT JOIN e ON e.o_custkey = o.o_custkey, p""")
def l6(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    out = encode.james_stein(orders.filter(_OTRAIN), "o_custkey", "o_totalprice").apply(orders)
    return out.select("o_orderkey", r4("o_custkey_js", 3).alias("o_custkey_js"))


@query("l7_fourier", "SELECT o_orderkey, " + ", ".join(
    f"round({fn}(2.0 * {i} * pi() * dayofyear(o_orderdate) / 365.0), 6) AS {fn}_{i}" for i in range(1, 6) for fn in ("sin", "cos")) + " FROM orders")
def l7(spark, sf):
    out = encode.fourier(table(spark, sf, "orders").select("o_orderkey", "o_orderdate"), "o_orderdate").drop("o_orderdate")
    return out.select("o_orderkey", *[(r4(c, 6) + 0.0).alias(c) for c in out.columns[1:]])


@query("l8_calendar_features", """
SELECT o_orderkey, dayname(o_orderdate) AS day_name, monthname(o_orderdate) AS month, CAST(year(o_orderdate) AS INTEGER) AS year,
 strftime(o_orderdate, '%Y-%m') AS yr_month, CAST(dayofyear(o_orderdate) AS INTEGER) AS yday FROM orders""")
def l8(spark, sf):
    return encode.calendar_features(table(spark, sf, "orders").select("o_orderkey", "o_orderdate"), "o_orderdate").drop("o_orderdate")


@query("l9_log_scale", """
SELECT o_orderkey, round(ln(1 + o_totalprice), 5) AS logged, round(exp(ln(1 + o_totalprice)) - 1, 3) AS back FROM orders""")
def l9(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", F.col("o_totalprice").alias("logged"))
    logged = encode.log_scale(orders, ["logged"]).withColumn("back", F.col("logged"))
    return encode.unlog(logged, ["back"]).select("o_orderkey", r4("logged", 5).alias("logged"), r4("back", 3).alias("back"))


@query("l10_buckets_and_flags", """
SELECT p_partkey, CAST(floor(p_size / 15.0) * 15 AS DOUBLE) AS size_bucket, CAST(len(string_split(p_name, ' ')) + 1 AS INTEGER) AS words_and_self,
 CASE WHEN p_type = 'PROMO' THEN 1 ELSE 0 END AS promo FROM part""")
def l10(spark, sf):
    from tabkit.functions.scalars import floor_bucket
    return table(spark, sf, "part").select(
        "p_partkey", floor_bucket(F.col("p_size"), 15).cast("double").alias("size_bucket"),
        (F.size(F.split("p_name", " ")) + 1).alias("words_and_self"), F.when(F.col("p_type") == "PROMO", 1).otherwise(0).alias("promo"))


@query("l11_weight_features", """
WITH c AS (SELECT 'l_quantity' AS k, abs(corr(l_quantity, l_extendedprice)) AS w FROM lineitem UNION ALL SELECT 'l_discount', abs(corr(l_discount, l_extendedprice)) FROM lineitem
 UNION ALL SELECT 'l_tax', abs(corr(l_tax, l_extendedprice)) FROM lineitem), t AS (SELECT k FROM c ORDER BY w DESC, k LIMIT 2)
SELECT l_returnflag, round(SUM(l_quantity * CASE WHEN 'l_quantity' IN (SELECT k FROM t) THEN 1000 ELSE 1 END), 2) AS l_quantity,
 round(SUM(l_discount * CASE WHEN 'l_discount' IN (SELECT k FROM t) THEN 1000 ELSE 1 END), 2) AS l_discount,
 round(SUM(l_tax * CASE WHEN 'l_tax' IN (SELECT k FROM t) THEN 1000 ELSE 1 END), 2) AS l_tax FROM lineitem GROUP BY 1""")
def l11(spark, sf):
    df = table(spark, sf, "lineitem")
    cols = ["l_quantity", "l_discount", "l_tax"]
    scores = {r["column"]: abs(r["corr"]) for r in stats.target_correlations(df, "l_extendedprice", cols).collect()}
    out = encode.weight_features(df, scores, 2)
    return out.groupBy("l_returnflag").agg(*[r4(F.sum(c), 2).alias(c) for c in cols])


@query("l13_landmark_isomap")
def l13(spark, sf):
    return encode.landmark_isomap(table(spark, sf, "embeddings"), "vec_id", "embedding", components=4, n_neighbors=10)


@query("l14_smote")
def l14(spark, sf):
    return encode.smote(table(spark, sf, "embeddings"), "label", "vec_id", "embedding", 5, seed=4)


# ---- statistics


@query("m1_binom_test")
def m1(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "lang")
    return stats.binom_test(table(spark, sf, "labels").join(docs, "doc_id"), ["lang"], "quality")


_JB = " UNION ALL ".join(f"""SELECT '{c}' AS "column", n, round(n / 6.0 * (pow(s, 2) + pow(k, 2) / 4.0), 2) AS jb,
  round(exp(-(n / 6.0 * (pow(s, 2) + pow(k, 2) / 4.0)) / 2), 6) AS p_value FROM (SELECT COUNT(*) AS n, AVG(pow({c} - m, 3)) / pow(any_value(v), 1.5) AS s,
  AVG(pow({c} - m, 4)) / pow(any_value(v), 2) - 3 AS k FROM lineitem, (SELECT AVG({c}) AS m, var_pop({c}) AS v FROM lineitem))"""
                         for c in ("l_quantity", "l_discount", "l_tax"))


@query("m2_jarque_bera", _JB)
def m2(spark, sf):
    out = stats.jarque_bera(table(spark, sf, "lineitem"), ["l_quantity", "l_discount", "l_tax"])
    return out.withColumns({"jb": r4("jb", 2), "p_value": r4("p_value", 6)})


@query("m2_shapiro_francia", f"""
WITH r AS (SELECT event_type, value AS v, CAST(row_number() OVER (PARTITION BY event_type ORDER BY value) AS DOUBLE) AS i,
  CAST(COUNT(*) OVER (PARTITION BY event_type) AS DOUBLE) AS n FROM events),
s AS (SELECT event_type, v, {normal_quantile_sql('((i-0.375E0)/(n+0.25E0))')} AS s FROM r)
SELECT event_type, COUNT(*) AS n, round(pow(corr(v, s), 2), 6) AS w FROM s GROUP BY 1""")
def m2b(spark, sf):
    return stats.shapiro_francia(table(spark, sf, "events"), "value", ["event_type"]).withColumn("w", r4("w", 6))


@query("m3_anova", " UNION ALL ".join(f"""
SELECT '{f}' AS factor, COUNT(*) - 1 AS df1, CAST(SUM(n) AS BIGINT) - COUNT(*) AS df2,
  round((SUM(n * pow(m - g, 2)) / (COUNT(*) - 1)) / (SUM(n * v) / (SUM(n) - COUNT(*))), 4) AS f
FROM (SELECT {f}, COUNT(*) AS n, AVG(o_totalprice) AS m, var_pop(o_totalprice) AS v FROM orders GROUP BY 1), (SELECT AVG(o_totalprice) AS g FROM orders)"""
                                      for f in ("o_orderpriority", "o_orderstatus", "o_custkey")))
def m3(spark, sf):
    out = stats.anova(table(spark, sf, "orders"), ["o_orderpriority", "o_orderstatus", "o_custkey"], "o_totalprice")
    return out.select("factor", "df1", "df2", r4("f").alias("f"))


def _customers(spark, sf):
    spent = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        F.count(F.lit(1)).cast("double").alias("n"), F.sum("o_totalprice").alias("spent"))
    return table(spark, sf, "customer").join(spent, "c_custkey").select(
        "c_custkey", "c_mktsegment", "c_acctbal", F.col("c_nationkey").cast("double").alias("nation"), "n", "spent",
        (F.col("n") > 10).alias("frequent"))


_CUSTOMERS = """c AS (SELECT c_custkey, c_mktsegment, c_acctbal, CAST(c_nationkey AS DOUBLE) AS nation, n, spent, n > 10 AS frequent
 FROM customer JOIN (SELECT o_custkey, CAST(COUNT(*) AS DOUBLE) AS n, SUM(o_totalprice) AS spent FROM orders GROUP BY 1) ON o_custkey = c_custkey)"""


@query("m4_select_by_corr", f"""
WITH {_CUSTOMERS} SELECT * FROM (SELECT 'n' AS "column", round(corr(n, spent), 6) AS corr FROM c
 UNION ALL SELECT 'c_acctbal', round(corr(c_acctbal, spent), 6) FROM c UNION ALL SELECT 'nation', round(corr(nation, spent), 6) FROM c) WHERE abs(corr) > 0.3""")
def m4(spark, sf):
    out = stats.select_by_corr(_customers(spark, sf), "spent", ["n", "c_acctbal", "nation"], 0.3)
    return out.withColumn("corr", r4("corr", 6))


@query("m5_select_features", f"WITH {_CUSTOMERS} SELECT c_custkey, n, frequent FROM c WHERE c_custkey % 5 = 0")
def m5(spark, sf):
    c = _customers(spark, sf)
    train, test = c.filter("c_custkey % 5 <> 0"), c.filter("c_custkey % 5 = 0").drop("spent")
    picked = stats.select_features(train, test, "spent", ["n", "c_acctbal", "nation"], ["frequent", "c_mktsegment"], level=1e-6)
    return test.select("c_custkey", *picked)


_FIT1 = """f AS (SELECT COUNT(*) AS n, AVG(l_quantity) AS mx, regr_sxx(l_extendedprice, l_quantity) AS sxx, regr_syy(l_extendedprice, l_quantity) AS syy, regr_sxy(l_extendedprice, l_quantity) AS sxy,
 regr_slope(l_extendedprice, l_quantity) AS b, regr_intercept(l_extendedprice, l_quantity) AS a FROM lineitem), g AS (SELECT *, syy - b * sxy AS sse FROM f)"""


def _fit(spark, sf):
    return stats.ols(table(spark, sf, "lineitem"), "l_extendedprice", ["l_quantity"])


@query("m6_ols", f"""
WITH {_FIT1} SELECT '(Intercept)' AS term, round(a, 3) AS estimate, round(sqrt(sse / (n - 2) * (1.0 / n + mx * mx / sxx)), 4) AS std_error, round(a / sqrt(sse / (n - 2) * (1.0 / n + mx * mx / sxx)), 3) AS statistic, round(1 - sse / syy, 6) AS r2 FROM g
UNION ALL SELECT 'l_quantity', round(b, 3), round(sqrt(sse / (n - 2) / sxx), 4), round(b / sqrt(sse / (n - 2) / sxx), 3), round(1 - sse / syy, 6) FROM g""")
def m6(spark, sf):
    fit = _fit(spark, sf)
    return fit.coefficients(spark).select("term", r4("estimate", 3).alias("estimate"), r4("std_error").alias("std_error"),
                                          r4("statistic", 3).alias("statistic"), F.round(F.lit(fit.r2), 6).alias("r2"))


@query("m7_confint")
def m7(spark, sf):
    return stats.confint(stats.ols(table(spark, sf, "lineitem"), "l_extendedprice", ["l_quantity", "l_discount", "l_tax"]), spark)


@query("m8_vif", """
SELECT UNNEST(['l_quantity', 'l_extendedprice']) AS "column", round(1 / (1 - pow(corr(l_quantity, l_extendedprice), 2)), 5) AS vif,
 sqrt(1 / (1 - pow(corr(l_quantity, l_extendedprice), 2))) > 2 AS inflated FROM lineitem""")
def m8(spark, sf):
    return stats.vif(table(spark, sf, "lineitem"), ["l_quantity", "l_extendedprice"]).withColumn("vif", r4("vif", 5))


@query("m9_residuals", f"""
WITH {_FIT1} SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(a + b * l_quantity, 3) AS fitted, round(l_extendedprice - a - b * l_quantity, 3) AS residual FROM lineitem, g""")
def m9(spark, sf):
    df = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    out = stats.residuals(stats.ols(df, "l_extendedprice", ["l_quantity"]), df)
    return out.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", r4("fitted", 3).alias("fitted"), r4("residual", 3).alias("residual"))


@query("m10_path_model", f"""
WITH {_FIT1} SELECT '(Intercept)' AS term, round(a, 3) AS estimate, round(a / sqrt(sse / n * (1.0 / n + mx * mx / sxx)), 3) AS z FROM g
UNION ALL SELECT 'l_quantity', round(b, 3), round(b / sqrt(sse / n / sxx), 3) FROM g""")
def m10(spark, sf):
    out = stats.path_model(table(spark, sf, "lineitem"), "l_extendedprice", ["l_quantity"])
    return out.select("term", r4("estimate", 3).alias("estimate"), r4("z", 3).alias("z"))


@query("m12_acf", f"""
WITH {DAILY_CTE}, e AS (SELECT prio, d, qty - AVG(qty) OVER (PARTITION BY prio) AS e FROM facts),
n AS (SELECT CAST(floor(10 * log10(MAX(c))) AS INTEGER) AS k FROM (SELECT COUNT(*) AS c FROM facts GROUP BY prio)),
r AS (SELECT prio, e, row_number() OVER (PARTITION BY prio ORDER BY d) AS i FROM e)
SELECT a.prio, CAST(k.k AS INTEGER) AS lag, round(SUM(a.e * b.e) / any_value(t.ss), 5) AS acf FROM r a CROSS JOIN (SELECT UNNEST(range((SELECT k FROM n) + 1)) AS k) k JOIN r b ON a.prio = b.prio AND b.i = a.i - k.k
JOIN (SELECT prio, SUM(e * e) AS ss FROM e GROUP BY 1) t ON t.prio = a.prio GROUP BY 1, 2""")
def m12(spark, sf):
    from tabkit.plans.registry import daily_facts
    return stats.acf(daily_facts(spark, sf), ["prio"], ["d"], "qty", split=False).withColumn("acf", r4("acf", 5))


@query("m13_decompose", f"""
WITH {DAILY_CTE}, x AS (SELECT k.prio, s.d, COALESCE(f.qty, 0) AS qty FROM (SELECT DISTINCT prio FROM facts) k CROSS JOIN spine s LEFT JOIN facts f ON f.prio = k.prio AND f.d = s.d),
t AS (SELECT prio, d, qty, CAST((row_number() OVER o - 1) % 12 AS INTEGER) AS phase, CASE WHEN COUNT(qty) OVER w = 13 THEN (SUM(qty) OVER w - (lag(qty, 6) OVER o + lead(qty, 6) OVER o) / 2.0) / 12 END AS trend
 FROM x WINDOW o AS (PARTITION BY prio ORDER BY d), w AS (PARTITION BY prio ORDER BY d ROWS BETWEEN 6 PRECEDING AND 6 FOLLOWING)),
s AS (SELECT prio, phase, AVG(qty - trend) AS s FROM t GROUP BY 1, 2), c AS (SELECT prio, phase, s - AVG(s) OVER (PARTITION BY prio) AS seasonal FROM s)
SELECT t.prio, t.d, round(trend, 4) AS trend, round(seasonal, 4) AS seasonal, round(qty - trend - seasonal, 4) AS remainder FROM t JOIN c ON c.prio = t.prio AND c.phase = t.phase""")
def m13(spark, sf):
    from tabkit.operators.joins import align_to_spine
    from tabkit.plans.registry import daily_facts
    from tabkit.sources.calendars import calendar_of

    spine = calendar_of(table(spark, sf, "orders"), "o_orderdate", "d")
    x = align_to_spine(daily_facts(spark, sf), spine, "d", ["prio"]).fillna(0.0, ["qty"])
    out = stats.decompose(x, ["prio"], ["d"], "qty", 12, split=False)
    return out.select("prio", "d", *[r4(c).alias(c) for c in ("trend", "seasonal", "remainder")])


_STOP = ", ".join("'" + w.replace("'", "''") + "'" for w in stats.STOPWORDS)


@query("m14_term_freq", f"""
WITH t AS (SELECT UNNEST(regexp_split_to_array(regexp_replace(regexp_replace(lower(text), '[!-/:-@\\[-`{{-~]', '', 'g'), '[0-9]+', '', 'g'), '[ \\t\\n\\r\\f\\x0B]+')) AS term FROM documents)
SELECT term, COUNT(*) AS n FROM t WHERE length(term) >= 3 AND term NOT IN ({_STOP}) GROUP BY 1 ORDER BY n DESC, term LIMIT 100""")
def m14(spark, sf):
    return stats.term_freq(table(spark, sf, "documents"), "text")


@query("m15_group_profile", """
WITH w AS (SELECT p_partkey, UNNEST(string_split(p_name, ' ')) AS word, p_retailprice, p_size FROM part)
SELECT word, COUNT(*) AS n, round(COUNT(*) * 100.0 / CAST((SELECT COUNT(*) FROM w) AS DOUBLE), 4) AS pct, round(AVG(p_retailprice), 4) AS p_retailprice_mean, round(AVG(p_size), 4) AS p_size_mean FROM w GROUP BY 1""")
def m15(spark, sf):
    from tabkit.operators.reshape import separate_rows
    w = separate_rows(table(spark, sf, "part").withColumn("word", F.col("p_name")), "word", " ")
    out = stats.group_profile(w, "p_partkey", "word", ["p_retailprice", "p_size"])
    return out.withColumns({c: r4(c) for c in ("pct", "p_retailprice_mean", "p_size_mean")})
