"""Aggregations, neighbouring rows, sorting and reshaping over the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabkit.operators import agg, reshape, windows
from tabkit.plans.registry import CUSTOMER_GAPS, DAILY_CTE, customer_gaps, daily_panel, query, r4, table

# ---- aggregations


@query("e1_rate_by", """
SELECT lang, COUNT(*) AS n, CAST(SUM(quality) AS BIGINT) AS hits, round(AVG(CAST(quality AS DOUBLE)), 4) AS rate
FROM labels l JOIN documents d ON l.doc_id = d.doc_id GROUP BY 1""")
def e1(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "lang")
    out = agg.rate_by(table(spark, sf, "labels").join(docs, "doc_id"), ["lang"], "quality")
    return out.withColumn("rate", r4("rate"))


@query("e2_group_means", """
SELECT p_type, round(AVG(l_extendedprice), 4) AS price, round(AVG(l_quantity), 4) AS quantity,
  round(AVG(l_extendedprice) / AVG(l_quantity), 4) AS ratio FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1""")
def e2(spark, sf):
    part = table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), "p_type")
    return table(spark, sf, "lineitem").join(part, "l_partkey").groupBy("p_type").agg(
        r4(F.avg("l_extendedprice")).alias("price"), r4(F.avg("l_quantity")).alias("quantity"),
        r4(F.avg("l_extendedprice") / F.avg("l_quantity")).alias("ratio"))


@query("e3_daily_sum", "SELECT CAST(o_orderdate AS DATE) AS d, round(SUM(o_totalprice), 2) AS total FROM orders GROUP BY 1")
def e3(spark, sf):
    return table(spark, sf, "orders").groupBy(F.to_date("o_orderdate").alias("d")).agg(
        r4(F.sum("o_totalprice"), 2).alias("total"))


@query("e4_freq", "SELECT p_brand, COUNT(*) AS n FROM part GROUP BY 1")
def e4(spark, sf):
    return agg.freq(table(spark, sf, "part"), "p_brand")


@query("e5_freq_pct", """
SELECT l_returnflag, l_linestatus, COUNT(*) AS n, round(COUNT(*) * 100.0 / CAST((SELECT COUNT(*) FROM lineitem) AS DOUBLE), 4) AS pct
FROM lineitem GROUP BY 1, 2""")
def e5(spark, sf):
    out = agg.freq(table(spark, sf, "lineitem"), ["l_returnflag", "l_linestatus"], pct=True)
    return out.withColumn("pct", r4("pct"))


@query("e6_crosstab", """
SELECT o_orderpriority, COUNT(*) FILTER (WHERE o_orderstatus = 'F') AS "F", COUNT(*) FILTER (WHERE o_orderstatus = 'O') AS "O",
  COUNT(*) FILTER (WHERE o_orderstatus = 'P') AS "P" FROM orders GROUP BY 1""")
def e6(spark, sf):
    return agg.crosstab_wide(table(spark, sf, "orders"), "o_orderpriority", "o_orderstatus", ["F", "O", "P"])


@query("e6_crosstab_long", """
SELECT c_mktsegment, o_orderstatus, o_orderpriority, COUNT(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2, 3""")
def e6b(spark, sf):
    customer = table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment")
    return agg.crosstab_long(table(spark, sf, "orders").join(customer, "o_custkey"),
                             ["c_mktsegment", "o_orderstatus", "o_orderpriority"])


@query("e7_histogram_width", """
SELECT l_returnflag, ceil((l_quantity - 2.5) / 5.0) * 5.0 AS bin, COUNT(*) AS n FROM lineitem GROUP BY 1, 2""")
def e7(spark, sf):
    return agg.histogram(table(spark, sf, "lineitem"), "l_quantity", width=5, by="l_returnflag")


@query("e8_histogram_bins", """
WITH e AS (SELECT MIN(p_retailprice) AS lo, (MAX(p_retailprice) - MIN(p_retailprice)) / 19.0 AS step FROM part)
SELECT p_type, round(lo + ceil((p_retailprice - lo) / step - 0.5) * step, 4) AS bin, COUNT(*) AS n FROM part, e GROUP BY 1, 2""")
def e8(spark, sf):
    return agg.histogram(table(spark, sf, "part"), "p_retailprice", bins=20, by="p_type").withColumn("bin", r4("bin"))


@query("e9_density", """
WITH s AS (SELECT event_type, MIN(value) AS lo, MAX(value) AS hi, COUNT(*) AS n,
    0.9 * least(stddev_samp(value), (quantile_cont(value, 0.75) - quantile_cont(value, 0.25)) / 1.34) * pow(COUNT(*), -0.2) AS bw
    FROM events GROUP BY 1),
g AS (SELECT s.*, j AS point, lo + (hi - lo) * (j / 15.0) AS x FROM s, (SELECT CAST(UNNEST(range(16)) AS INTEGER) AS j))
SELECT g.event_type, point, round(x, 4) AS x, round(SUM(exp(-0.5 * pow((value - x) / bw, 2))) / (any_value(n) * any_value(bw) * sqrt(2 * pi())), 6) AS density
FROM g JOIN events e ON e.event_type = g.event_type GROUP BY 1, 2, x""")
def e9(spark, sf):
    out = agg.density(table(spark, sf, "events"), "value", "event_type", points=16)
    return out.withColumns({"x": r4("x"), "density": r4("density", 6)})


@query("e10_describe", f"""
WITH c AS {CUSTOMER_GAPS}
SELECT c_mktsegment, 'bal' AS "column", COUNT(bal) AS n, round(AVG(bal), 4) AS mean, round(stddev_samp(bal), 4) AS sd, MIN(bal) AS min,
  round(quantile_cont(bal, 0.25), 4) AS q25, round(quantile_cont(bal, 0.5), 4) AS median, round(quantile_cont(bal, 0.75), 4) AS q75, MAX(bal) AS max
FROM c GROUP BY 1""")
def e10(spark, sf):
    out = agg.describe_num(customer_gaps(spark, sf), ["bal"], ["c_mktsegment"])
    return out.withColumns({c: r4(c) for c in ("mean", "sd", "q25", "median", "q75")})


@query("e11_mode_smallest", """
SELECT p_type, p_size AS mode, n FROM (SELECT p_type, p_size, COUNT(*) AS n, row_number() OVER (PARTITION BY p_type
    ORDER BY COUNT(*) DESC, p_size) AS r FROM part GROUP BY 1, 2) WHERE r = 1""")
def e11(spark, sf):
    return agg.mode_of(table(spark, sf, "part"), "p_size", ["p_type"])


@query("e11_mode_first_seen", """
SELECT p_type, p_size AS mode, n FROM (SELECT p_type, p_size, COUNT(*) AS n, row_number() OVER (PARTITION BY p_type
    ORDER BY COUNT(*) DESC, MIN(p_partkey)) AS r FROM part GROUP BY 1, 2) WHERE r = 1""")
def e11b(spark, sf):
    return agg.mode_of(table(spark, sf, "part"), "p_size", ["p_type"], ties="first", order="p_partkey")


@query("e12_distinct_on", """
SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS r
FROM orders) WHERE r = 1""")
def e12(spark, sf):
    df = table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_totalprice", "o_orderdate")
    return agg.distinct_on(df, ["o_custkey"], ["o_orderdate", "o_orderkey"]).drop("o_orderdate")


@query("e13_distinct", "SELECT DISTINCT l_partkey, l_suppkey FROM lineitem")
def e13(spark, sf):
    return table(spark, sf, "lineitem").select("l_partkey", "l_suppkey").distinct()


@query("e14_share_where", """
SELECT o_custkey, round(AVG(CASE WHEN o_totalprice > 200000 THEN 1.0 ELSE 0.0 END), 4) AS share FROM orders GROUP BY 1""")
def e14(spark, sf):
    out = agg.share_where(table(spark, sf, "orders"), ["o_custkey"], F.col("o_totalprice") > 200000)
    return out.withColumn("share", r4("share"))


@query("e15_corr_by", """
SELECT l_returnflag, round(corr(l_quantity, l_extendedprice), 6) AS corr FROM lineitem GROUP BY 1""")
def e15(spark, sf):
    return agg.corr_by(table(spark, sf, "lineitem"), "l_quantity", "l_extendedprice", ["l_returnflag"]).withColumn(
        "corr", r4("corr", 6))


_NUMS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("e16_corr_matrix", " UNION ALL ".join(
    f"SELECT '{a}' AS var1, '{b}' AS var2, " + ("CAST(1.0 AS DOUBLE) AS corr" if a == b else f"round(corr({a}, {b}), 6) FROM lineitem")
    for a in _NUMS for b in _NUMS))
def e16(spark, sf):
    return agg.corr_matrix(table(spark, sf, "lineitem"), _NUMS).withColumn("corr", r4("corr", 6))


@query("e17_collect_text", """
SELECT o_custkey, string_agg(CAST(o_orderkey AS VARCHAR), ', ' ORDER BY r) AS o_orderkey FROM (SELECT o_custkey, o_orderkey,
    row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) WHERE r <= 3 GROUP BY 1""")
def e17(spark, sf):
    best = agg.top_k(table(spark, sf, "orders"), [F.desc("o_totalprice"), "o_orderkey"], 3, ["o_custkey"])
    return agg.collect_text(best, ["o_custkey"], "o_orderkey", ["rank"])


@query("e18_mismatch", """
SELECT COUNT(*) AS n, COUNT(*) FILTER (WHERE p <> quality) AS errors, round(100.0 * AVG(CASE WHEN p <> quality THEN 1.0 ELSE 0.0 END), 4) AS error_pct,
  round(100.0 * AVG(CASE WHEN p = quality THEN 1.0 ELSE 0.0 END), 4) AS correct_pct
FROM (SELECT quality, CASE WHEN n_chars > 1000 THEN 1 ELSE 0 END AS p FROM labels l JOIN documents d ON l.doc_id = d.doc_id)""")
def e18(spark, sf):
    scored = table(spark, sf, "labels").join(table(spark, sf, "documents"), "doc_id").withColumn(
        "p", F.when(F.col("n_chars") > 1000, 1).otherwise(0))
    return agg.mismatch(scored, "p", "quality").withColumns({c: r4(c) for c in ("error_pct", "correct_pct")})


@query("e19_zero_inflated", """
SELECT l_linenumber, round(SUM(disc), 4) AS disc, round(SUM(l_tax), 4) AS tax FROM (SELECT l_linenumber, l_tax,
    CASE WHEN (SELECT AVG(CASE WHEN greatest(l_discount - 0.07, 0) = 0 THEN 1.0 ELSE 0.0 END) FROM lineitem) >= 0.5
    THEN CASE WHEN greatest(l_discount - 0.07, 0) <> 0 THEN 1.0 ELSE 0.0 END ELSE greatest(l_discount - 0.07, 0) END AS disc FROM lineitem) GROUP BY 1""")
def e19(spark, sf):
    df = table(spark, sf, "lineitem").select(
        "l_linenumber", F.greatest(F.col("l_discount") - 0.07, F.lit(0.0)).alias("disc"), F.col("l_tax").alias("tax"))
    out = agg.zero_inflated_to_binary(df, ["disc", "tax"], 0.5)
    return out.groupBy("l_linenumber").agg(r4(F.sum("disc")).alias("disc"), r4(F.sum("tax")).alias("tax"))


@query("e20_group_count", "SELECT COUNT(*) AS n_groups FROM (SELECT DISTINCT l_suppkey, l_returnflag FROM lineitem)")
def e20(spark, sf):
    return agg.group_count(table(spark, sf, "lineitem"), ["l_suppkey", "l_returnflag"])


# ---- neighbouring rows


@query("f1_lags", f"""
WITH {DAILY_CTE} SELECT prio, d, qty, lag(qty, 7) OVER w AS qty_lag_7, lag(qty, 14) OVER w AS qty_lag_14 FROM panel
WINDOW w AS (PARTITION BY prio ORDER BY d)""")
def f1(spark, sf):
    return windows.add_lags(daily_panel(spark, sf), ["prio"], ["d"], "qty", [7, 14], split=False)


@query("f2_leads", """
SELECT o_custkey, o_orderkey, lead(o_orderstatus) OVER w AS next_o_orderstatus, lead(o_totalprice) OVER w AS next_o_totalprice FROM orders
WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)""")
def f2(spark, sf):
    out = windows.add_leads(table(spark, sf, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"],
                            ["o_orderstatus", "o_totalprice"])
    return out.select("o_custkey", "o_orderkey", "next_o_orderstatus", "next_o_totalprice")


@query("f3_rolling_mean", f"""
WITH {DAILY_CTE} SELECT prio, d, round(AVG(qty) OVER (PARTITION BY prio ORDER BY d ROWS BETWEEN 6 PRECEDING AND CURRENT ROW), 6) AS qty_mean_7 FROM panel""")
def f3(spark, sf):
    out = windows.rolling_mean(daily_panel(spark, sf), ["prio"], ["d"], "qty", 7, split=False)
    return out.select("prio", "d", r4("qty_mean_7", 6).alias("qty_mean_7"))


@query("f4_group_mean", """
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, round_even(AVG(l_extendedprice) OVER (PARTITION BY l_suppkey), 0) AS price FROM lineitem""")
def f4(spark, sf):
    out = windows.group_mean(table(spark, sf, "lineitem"), ["l_suppkey"], "l_extendedprice", 0, "price")
    return out.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "price")


@query("f5_fill_downup", f"""
WITH {DAILY_CTE} SELECT prio, d, COALESCE(last_value(qty IGNORE NULLS) OVER (PARTITION BY prio ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
    first_value(qty IGNORE NULLS) OVER (PARTITION BY prio ORDER BY d ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS qty FROM panel""")
def f5(spark, sf):
    return windows.fill(daily_panel(spark, sf), ["prio"], ["d"], "qty", "downup", split=False)


@query("f5_fill_backward", f"""
WITH {DAILY_CTE} SELECT prio, d,
    first_value(qty IGNORE NULLS) OVER (PARTITION BY prio ORDER BY d ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS qty FROM panel""")
def f5b(spark, sf):
    return windows.fill(daily_panel(spark, sf), ["prio"], ["d"], "qty", "backward", split=False)


@query("f6_row_number", """
SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS position FROM events""")
def f6(spark, sf):
    from tabkit.operators.order import with_position
    return with_position(table(spark, sf, "events").select("event_id", "user_id", "ts"), ["ts", "event_id"], ["user_id"]).select(
        "event_id", "position")


_KINDS = "CASE CAST(dayofyear(o_orderdate) AS INTEGER) % 3 WHEN 0 THEN 'Holiday' WHEN 1 THEN 'Transfer' ELSE 'Event' END"


@query("f7_drop_superseded", f"""
SELECT o_custkey, o_orderkey, kind FROM (SELECT o_custkey, o_orderkey, CAST(o_orderdate AS DATE) AS d, {_KINDS} AS kind,
   lead(CAST(o_orderdate AS DATE)) OVER w AS nd, lead({_KINDS}) OVER w AS nk FROM orders
   WINDOW w AS (PARTITION BY o_custkey ORDER BY CAST(o_orderdate AS DATE), o_orderkey))
WHERE NOT COALESCE(kind = 'Holiday' AND nk = 'Transfer' AND nd - d <= 90, FALSE)""")
def f7(spark, sf):
    kind = F.expr("CASE dayofyear(o_orderdate) % 3 WHEN 0 THEN 'Holiday' WHEN 1 THEN 'Transfer' ELSE 'Event' END")
    df = table(spark, sf, "orders").select("o_custkey", "o_orderkey", F.to_date("o_orderdate").alias("d"), kind.alias("kind"))
    return windows.drop_superseded(df, ["o_custkey"], "d", "kind", days=90, order=["o_orderkey"]).drop("d")


@query("f8_zscore_by", """
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, round((l_extendedprice - AVG(l_extendedprice) OVER w) / stddev_samp(l_extendedprice) OVER w, 4) AS z
FROM lineitem WINDOW w AS (PARTITION BY l_returnflag)""")
def f8(spark, sf):
    out = windows.zscore(table(spark, sf, "lineitem"), ["l_extendedprice"], ["l_returnflag"])
    return out.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", r4("l_extendedprice_z").alias("z"))


@query("f9_group_median", """
SELECT o_orderkey, round(m, 4) AS o_totalprice_median FROM orders JOIN (SELECT o_orderpriority AS p, quantile_cont(o_totalprice, 0.5) AS m FROM orders GROUP BY 1)
ON p = o_orderpriority""")
def f9(spark, sf):
    df = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice")
    out = windows.group_median(df, ["o_orderpriority"], ["o_totalprice"])
    return out.select("o_orderkey", r4("o_totalprice_median").alias("o_totalprice_median"))


@query("f10_smooth_local", f"""
WITH {DAILY_CTE}, x AS (SELECT prio, d, CAST(date_diff('day', (SELECT MIN(d) FROM panel), d) AS DOUBLE) AS x, ln(1 + qty) AS qty FROM panel)
SELECT prio, d, round(COALESCE(regr_intercept(qty, x) OVER w + regr_slope(qty, x) OVER w * x, AVG(qty) OVER w), 5) AS smooth FROM x
WINDOW w AS (PARTITION BY prio ORDER BY d ROWS BETWEEN 15 PRECEDING AND 15 FOLLOWING)""")
def f10(spark, sf):
    panel = daily_panel(spark, sf)
    first = panel.agg(F.min("d")).scalar()
    x = panel.withColumn("x", F.datediff("d", first).cast("double")).withColumn("qty", F.log1p("qty"))
    return windows.smooth_local(x, ["prio"], ["d"], "x", "qty", 15, split=False).select("prio", "d", r4("smooth", 5).alias("smooth"))


# ---- sorts and top-k


@query("g1_sorted", "SELECT n_name, s_name, s_acctbal FROM supplier JOIN nation ON s_nationkey = n_nationkey ORDER BY s_acctbal DESC")
def g1(spark, sf):
    nation = table(spark, sf, "nation").select(F.col("n_nationkey").alias("s_nationkey"), "n_name")
    return table(spark, sf, "supplier").join(nation, "s_nationkey").select("n_name", "s_name", "s_acctbal").orderBy(
        F.desc("s_acctbal"))


@query("g2_head", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 6")
def g2(spark, sf):
    return agg.head_by(table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), [F.desc("o_totalprice"), "o_orderkey"])


@query("g3_rank_levels", """
SELECT p_brand, COUNT(*) AS n, row_number() OVER (ORDER BY COUNT(*) DESC, p_brand) AS level_rank FROM part GROUP BY 1""")
def g3(spark, sf):
    return agg.rank_levels(table(spark, sf, "part"), "p_brand")


@query("g4_top_k", """
SELECT l_suppkey, l_partkey, revenue, r AS rank FROM (SELECT l_suppkey, l_partkey, revenue, CAST(row_number() OVER (PARTITION BY l_suppkey ORDER BY revenue DESC, l_partkey) AS INTEGER) AS r
FROM (SELECT l_suppkey, l_partkey, round(SUM(l_extendedprice), 2) AS revenue FROM lineitem GROUP BY 1, 2)) WHERE r <= 3""")
def g4(spark, sf):
    sums = table(spark, sf, "lineitem").groupBy("l_suppkey", "l_partkey").agg(
        r4(F.sum("l_extendedprice"), 2).alias("revenue"))
    return agg.top_k(sums, [F.desc("revenue"), "l_partkey"], 3, ["l_suppkey"])


@query("g5_above", """
SELECT * FROM (SELECT p_brand, round(AVG(l_quantity), 4) AS score FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1) WHERE score > 25.5""")
def g5(spark, sf):
    part = table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand")
    scores = table(spark, sf, "lineitem").join(part, "l_partkey").groupBy("p_brand").agg(r4(F.avg("l_quantity")).alias("score"))
    return agg.above(scores, "score", 25.5)


# ---- reshaping


@query("j1_separate_rows", "SELECT p_partkey, trim(UNNEST(string_split(p_name, ' '))) AS word FROM part")
def j1(spark, sf):
    return reshape.separate_rows(table(spark, sf, "part").select("p_partkey", F.col("p_name").alias("word")), "word", " ")


@query("j2_indicators", """
SELECT o_custkey, MAX(CASE WHEN o_orderpriority = '1-URGENT' THEN 1 ELSE 0 END) AS x1_urgent, MAX(CASE WHEN o_orderpriority = '2-HIGH' THEN 1 ELSE 0 END) AS x2_high,
 MAX(CASE WHEN o_orderpriority = '3-MEDIUM' THEN 1 ELSE 0 END) AS x3_medium, MAX(CASE WHEN o_orderpriority = '4-NOT SPECIFIED' THEN 1 ELSE 0 END) AS x4_not_specified,
 MAX(CASE WHEN o_orderpriority = '5-LOW' THEN 1 ELSE 0 END) AS x5_low FROM orders GROUP BY 1""")
def j2(spark, sf):
    return reshape.indicators(table(spark, sf, "orders"), "o_custkey", "o_orderpriority",
                              ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"])


@query("j3_one_hot", """
SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS "o_orderstatus_F", CASE WHEN o_orderstatus = 'O' THEN 1 ELSE 0 END AS "o_orderstatus_O",
 CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END AS "o_orderstatus_P" FROM orders""")
def j3(spark, sf):
    return reshape.one_hot(table(spark, sf, "orders").select("o_orderkey", "o_orderstatus"), ["o_orderstatus"])


@query("j4_design_matrix", """
SELECT o_orderkey, o_totalprice AS label, CASE WHEN o_orderstatus = 'P' THEN 1.0 ELSE 0.0 END AS f1,
 CASE WHEN o_orderstatus = 'O' THEN 1.0 ELSE 0.0 END AS f2, CAST(month(o_orderdate) AS DOUBLE) AS f3 FROM orders""")
def j4(spark, sf):
    from pyspark.ml.functions import vector_to_array
    df = table(spark, sf, "orders").withColumn("m", F.month("o_orderdate"))
    out = reshape.design_matrix(df, "o_totalprice ~ o_orderstatus + m")
    x = vector_to_array("features")
    return out.select("o_orderkey", "label", *[x[i].alias(f"f{i + 1}") for i in range(3)])


@query("j5_sum_contrasts", """
SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'P' THEN -1 ELSE 0 END AS o_orderstatus_1,
 CASE o_orderstatus WHEN 'O' THEN 1 WHEN 'P' THEN -1 ELSE 0 END AS o_orderstatus_2 FROM orders""")
def j5(spark, sf):
    return reshape.sum_contrasts(table(spark, sf, "orders").select("o_orderkey", "o_orderstatus"), "o_orderstatus").drop(
        "o_orderstatus")


@query("j6_melt", """
SELECT l_returnflag, 'price' AS variable, round(AVG(l_extendedprice), 4) AS value FROM lineitem GROUP BY 1
UNION ALL SELECT l_returnflag, 'quantity', round(AVG(l_quantity), 4) FROM lineitem GROUP BY 1""")
def j6(spark, sf):
    wide = table(spark, sf, "lineitem").groupBy("l_returnflag").agg(
        r4(F.avg("l_extendedprice")).alias("price"), r4(F.avg("l_quantity")).alias("quantity"))
    return reshape.melt(wide, ["l_returnflag"])


@query("j7_merge_indicators", """
SELECT p_partkey, CASE WHEN p_type = 'ECONOMY' THEN 1 ELSE 0 END AS economy_type, CASE WHEN p_type = 'PROMO' THEN 1 ELSE 0 END AS promo_type,
 CASE WHEN list_contains(string_split(p_name, ' '), 'red') THEN 1 ELSE 0 END AS red, CASE WHEN list_contains(string_split(p_name, ' '), 'ring') THEN 1 ELSE 0 END AS ring FROM part""")
def j7(spark, sf):
    part = table(spark, sf, "part")
    kinds = reshape.indicators(part, "p_partkey", "p_type", ["ECONOMY", "PROMO"]).withColumnsRenamed(
        {"economy": "economy_type", "promo": "promo_type"})
    words = reshape.separate_rows(part.select("p_partkey", "p_name"), "p_name", " ")
    return kinds.join(reshape.indicators(words, "p_partkey", "p_name", ["red", "ring"]), "p_partkey", "left")


@query("j8_interaction_weights", """
SELECT o_custkey AS user_id, l_partkey AS item_id, SUM(1.0 + l_quantity + CASE WHEN p_type = 'ECONOMY' THEN 1 ELSE 0 END + CASE WHEN p_type = 'PROMO' THEN 1 ELSE 0 END) AS weight
FROM orders JOIN lineitem ON o_orderkey = l_orderkey JOIN part ON p_partkey = l_partkey GROUP BY 1, 2""")
def j8(spark, sf):
    flags = reshape.indicators(table(spark, sf, "part").withColumnRenamed("p_partkey", "item_id"), "item_id", "p_type",
                               ["ECONOMY", "PROMO"])
    ratings = table(spark, sf, "lineitem").join(
        table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("user_id")),
        "l_orderkey").select("user_id", F.col("l_partkey").alias("item_id"), "l_quantity")
    return reshape.interaction_weights(ratings, flags, "user_id", "item_id", "l_quantity", ["economy", "promo"])
