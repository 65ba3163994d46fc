"""Holiday calendars, panels and forecasts over the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabkit.operators import encode, forecast, impute, models, rows, series, windows
from tabkit.operators.agg import union_all
from tabkit.operators.joins import align_to_spine
from tabkit.plans.registry import DAILY_CTE, daily_facts, daily_panel, query, r4, table
from tabkit.sources.calendars import calendar_of, day_type_calendar

# ---- holidays


def _holidays(spark, sf):
    """A holiday table with an entry per order, by fixed rules on its key."""
    k = F.col("o_orderkey")
    kinds = ["Holiday", "Event", "Additional", "Transfer", "Bridge", "Work Day"]
    kind = F.element_at(F.array(*[F.lit(x) for x in kinds]), (k % 6 + 1).cast("int"))
    return table(spark, sf, "orders").select(
        k.alias("id"), F.to_date("o_orderdate").alias("date"), kind.alias("type"), F.col("o_orderpriority").alias("locale"),
        F.col("o_orderstatus").alias("locale_name"), (k % 28 == 0).alias("transferred"))


_HOLIDAYS = """h AS (SELECT o_orderkey AS id, CAST(o_orderdate AS DATE) AS date, ['Holiday','Event','Additional','Transfer','Bridge','Work Day'][o_orderkey % 6 + 1] AS type,
 o_orderpriority AS locale, o_orderstatus AS locale_name, o_orderkey % 28 = 0 AS transferred FROM orders),
clean AS (SELECT id, date, CASE WHEN type IN ('Bridge', 'Transfer') THEN 'Additional' ELSE type END AS type, locale, locale_name FROM h WHERE NOT transferred AND type <> 'Work Day')"""


@query("q1_clean_holidays", f"WITH {_HOLIDAYS} SELECT id, date, type, locale, locale_name FROM clean")
def q1(spark, sf):
    return series.clean_holidays(_holidays(spark, sf))


def _day_calendar(spark, sf):
    days = day_type_calendar(calendar_of(table(spark, sf, "orders"), "o_orderdate"))
    clean = series.clean_holidays(_holidays(spark, sf)).withColumnRenamed("type", "day_type").drop("locale_name")
    return series.holiday_calendar(days, clean, ["id"])


_CALENDAR = f"""{_HOLIDAYS}, days AS (SELECT CAST(UNNEST(generate_series((SELECT MIN(date) FROM h), (SELECT MAX(date) FROM h), INTERVAL 1 DAY)) AS DATE) AS date),
first_h AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY date ORDER BY id) AS r FROM clean) WHERE r = 1),
cal AS (SELECT d.date, COALESCE(f.type, CASE WHEN isodow(d.date) >= 6 THEN 'Holiday' ELSE 'Workday' END) AS day_type, COALESCE(f.locale, 'Ordinary') AS locale
 FROM days d LEFT JOIN first_h f ON f.date = d.date)"""


@query("q2_holiday_calendar", f"WITH {_CALENDAR} SELECT date, day_type, locale FROM cal")
def q2(spark, sf):
    return _day_calendar(spark, sf)


@query("q3_panel", f"""
WITH {_CALENDAR}, sales AS (SELECT l_suppkey, CAST(l_shipdate AS DATE) AS date, SUM(l_quantity) AS qty FROM lineitem GROUP BY 1, 2),
price AS (SELECT date, COUNT(*) AS n_orders FROM h GROUP BY 1)
SELECT s.l_suppkey, s.date, qty, n_name, n_orders, day_type, cal.locale, dayname(s.date) AS day_name, monthname(s.date) AS month, CAST(year(s.date) AS INTEGER) AS year,
 strftime(s.date, '%Y-%m') AS yr_month, CAST(dayofyear(s.date) AS INTEGER) AS yday FROM sales s LEFT JOIN supplier ON s_suppkey = l_suppkey LEFT JOIN nation ON n_nationkey = s_nationkey
LEFT JOIN price ON price.date = s.date LEFT JOIN cal ON cal.date = s.date""")
def q3(spark, sf):
    sales = table(spark, sf, "lineitem").groupBy("l_suppkey", F.to_date("l_shipdate").alias("date")).agg(F.sum("l_quantity").alias("qty"))
    nation = table(spark, sf, "nation").select(F.col("n_nationkey").alias("s_nationkey"), "n_name")
    place = table(spark, sf, "supplier").join(nation, "s_nationkey", "left").select(F.col("s_suppkey").alias("l_suppkey"), "n_name")
    price = table(spark, sf, "orders").groupBy(F.to_date("o_orderdate").alias("date")).agg(F.count(F.lit(1)).alias("n_orders"))
    return series.build_panel(sales, [(place, "l_suppkey"), (price, "date"), (_day_calendar(spark, sf), "date")], "date")


# ---- panels with lags


_TAGGED = f"""{DAILY_CTE}, lim AS (SELECT MAX(d) - 15 AS cut FROM spine),
placed AS (SELECT prio, d, qty, row_number() OVER (PARTITION BY prio ORDER BY d) AS x FROM panel),
ends AS (SELECT *, last_value(CASE WHEN qty IS NOT NULL THEN x END IGNORE NULLS) OVER b AS x0, last_value(qty IGNORE NULLS) OVER b AS y0,
  first_value(CASE WHEN qty IS NOT NULL THEN x END IGNORE NULLS) OVER a AS x1, first_value(qty IGNORE NULLS) OVER a AS y1 FROM placed
  WINDOW b AS (PARTITION BY prio ORDER BY x ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), a AS (PARTITION BY prio ORDER BY x ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
filled AS (SELECT prio, d, round(COALESCE(qty, y0 + (y1 - y0) * ((x - x0) / NULLIF(CAST(x1 - x0 AS DOUBLE), 0)), y1, y0), 6) AS qty FROM ends),
lagged AS (SELECT prio, d, qty, CASE WHEN d >= (SELECT cut FROM lim) THEN 'test' ELSE 'train' END AS data_type, lag(qty, 7) OVER o AS qty_lag_7, lag(qty, 14) OVER o AS qty_lag_14,
  round(AVG(qty) OVER (PARTITION BY prio ORDER BY d ROWS BETWEEN 6 PRECEDING AND CURRENT ROW), 8) AS qty_mean_7 FROM filled WINDOW o AS (PARTITION BY prio ORDER BY d))"""


def _filled_panel(spark, sf):
    filled = impute.interpolate(daily_panel(spark, sf), ["prio"], ["d"], "qty", "linear", split=False).withColumn("qty", r4("qty", 6))
    cut = table(spark, sf, "orders").agg(F.date_sub(F.max(F.to_date("o_orderdate")), 15)).scalar()
    return filled.withColumn("data_type", F.when(F.col("d") >= cut, "test").otherwise("train"))


@query("q4_lag_features", f"""
WITH {_TAGGED} SELECT prio, d, qty, data_type, qty_lag_7, qty_lag_14, qty_mean_7, dayname(d) AS day_name, monthname(d) AS month, CAST(year(d) AS INTEGER) AS year,
 strftime(d, '%Y-%m') AS yr_month, CAST(dayofyear(d) AS INTEGER) AS yday FROM lagged WHERE data_type = 'test' OR (qty_lag_7 IS NOT NULL AND qty_lag_14 IS NOT NULL)""")
def q4(spark, sf):
    panel = encode.calendar_features(_filled_panel(spark, sf), "d")
    panel = windows.rolling_mean(panel, ["prio"], ["d"], "qty", 7, split=False).withColumn("qty_mean_7", r4("qty_mean_7", 8))
    return series.lag_features(panel, ["prio"], ["d"], "qty", [7, 14], split=False)


# ---- forecasts


def _sales(spark, sf):
    """Complete daily totals per priority and per event type, with a weekend flag; the last 16 days are to forecast."""
    per_event = table(spark, sf, "events").groupBy(F.col("event_type").alias("name"), F.to_date("ts").alias("d")).agg(F.sum("value").alias("y"))
    per_order = daily_facts(spark, sf).select(F.col("prio").alias("name"), "d", F.col("qty").alias("y"))
    parts = []
    for facts in (per_order, per_event):
        spine = calendar_of(facts, "d", "d")
        full = align_to_spine(facts, spine, "d", ["name"]).fillna(0.0, ["y"])
        cut = facts.agg(F.date_sub(F.max("d"), 15)).scalar()
        parts.append(full.withColumns({"weekend": F.when(F.weekday("d") >= 5, 1.0).otherwise(0.0), "test": F.col("d") >= cut}))
    return rows.split_by(union_all(parts), ~F.col("test"))


_SALES = f"""{DAILY_CTE}, ev AS (SELECT event_type AS name, CAST(ts AS DATE) AS d, SUM(value) AS y FROM events GROUP BY 1, 2),
es AS (SELECT CAST(UNNEST(generate_series((SELECT MIN(d) FROM ev), (SELECT MAX(d) FROM ev), INTERVAL 1 DAY)) AS DATE) AS d),
fs AS (SELECT CAST(UNNEST(generate_series((SELECT MIN(d) FROM facts), (SELECT MAX(d) FROM facts), INTERVAL 1 DAY)) AS DATE) AS d),
s AS (SELECT k.name, e.d, COALESCE(ev.y, 0) AS y, e.d >= (SELECT MAX(d) - 15 FROM ev) AS test FROM (SELECT DISTINCT name FROM ev) k CROSS JOIN es e LEFT JOIN ev ON ev.name = k.name AND ev.d = e.d
 UNION ALL SELECT k.prio, f.d, COALESCE(x.qty, 0), f.d >= (SELECT MAX(d) - 15 FROM facts) FROM (SELECT DISTINCT prio FROM facts) k CROSS JOIN fs f LEFT JOIN facts x ON x.prio = k.prio AND x.d = f.d),
tail AS (SELECT name, 7 - r AS slot, y FROM (SELECT name, y, row_number() OVER (PARTITION BY name ORDER BY d DESC) AS r FROM s WHERE NOT test) WHERE r <= 7),
naive AS (SELECT a.name, a.d, t.y AS prediction FROM (SELECT name, d, (row_number() OVER (PARTITION BY name ORDER BY d) - 1) % 7 AS slot FROM s WHERE test) a JOIN tail t ON t.name = a.name AND t.slot = a.slot)"""


def _with_regressors(spark, sf, panel):
    """Day type and its locale, weekday and month as categories; mean price, orders and their weekly mean as numbers."""
    daily = table(spark, sf, "orders").groupBy(F.to_date("o_orderdate").alias("d")).agg(
        F.avg("o_totalprice").alias("price"), F.count(F.lit(1)).cast("double").alias("n_orders"))
    daily = windows.rolling_mean(daily, [], ["d"], "n_orders", 7, split=False)
    days = _day_calendar(spark, sf).withColumnRenamed("date", "d")
    return panel.join(daily, "d", "left").join(days, "d", "left").withColumns(
        {"weekday": F.date_format("d", "EEEE"), "year_mo": F.date_format("d", "yyyy-MM")})


@query("q5_forecast_arx")
def q5(spark, sf):
    train, test = [_with_regressors(spark, sf, side) for side in _sales(spark, sf)]
    out = series.forecast_groups(train, test, ["name"], "d", "y", ["weekend", "price", "n_orders", "n_orders_mean_7"], "arx",
                                 categories=["day_type", "locale", "weekday", "year_mo"])
    return series.finish_forecast(out, ["name", "d"], "y")


@query("q5_forecast_order_one", f"""
WITH {_SALES}, lagged AS (SELECT name, d, y, lag(y) OVER (PARTITION BY name ORDER BY d) AS y1 FROM s WHERE NOT test),
fit AS (SELECT name, regr_slope(y, y1) AS b, regr_intercept(y, y1) AS a, regr_syy(y, y1) AS syy, regr_sxx(y, y1) AS sxx, regr_sxy(y, y1) AS sxy,
  regr_avgy(y, y1) AS m, CAST(COUNT(y1) AS DOUBLE) AS n FROM lagged GROUP BY name),
picked AS (SELECT *, n * ln((syy - sxy * sxy / sxx) / n) + 4 < n * ln(syy / n) + 2 AS one FROM fit),
newest AS (SELECT name, arg_max(y, d) AS last FROM s WHERE NOT test GROUP BY name),
steps AS (SELECT name, d, row_number() OVER (PARTITION BY name ORDER BY d) AS h FROM s WHERE test)
SELECT t.name, t.d, round(CASE WHEN one THEN a / (1 - b) + (last - a / (1 - b)) * pow(b, h) ELSE m END, 4) AS prediction
FROM steps t JOIN picked p ON p.name = t.name JOIN newest l ON l.name = t.name""")
def q5_order_one(spark, sf):
    train, test = _sales(spark, sf)
    out = series.forecast_groups(train, test, ["name"], "d", "y", method="arx", log=False, max_order=1)
    return out.select("name", "d", r4("prediction").alias("prediction"))


def _feasts(spark, sf):
    """Holidays of the order table that fall on the first of a quarter, with the days around them."""
    days = series.holiday_regressors(_holidays(spark, sf)).filter((F.dayofmonth("date") <= 2) & (F.month("date") % 3 == 1))
    return forecast.holiday_effects(days.withColumns({"lower": F.lit(-1), "upper": F.lit(1)}), "date", "locale_name", "lower", "upper").withColumnRenamed("date", "d")


@query("q6_forecast_additive")
def q6(spark, sf):
    train, test = [_with_regressors(spark, sf, side) for side in _sales(spark, sf)]
    out = series.forecast_groups(train, test, ["name"], "d", "y", ["weekend", "price"], "additive", effects=_feasts(spark, sf))
    return series.finish_forecast(out, ["name", "d"], "y")


@query("q6_forecast_trend", f"""
WITH {_SALES}, line AS (SELECT name, regr_slope(y, CAST(d - DATE '1970-01-01' AS DOUBLE)) AS b, AVG(y) AS my, AVG(CAST(d - DATE '1970-01-01' AS DOUBLE)) AS mx
  FROM s WHERE NOT test GROUP BY name)
SELECT s.name, s.d, round(my + b * (CAST(s.d - DATE '1970-01-01' AS DOUBLE) - mx), 4) AS prediction FROM s JOIN line ON line.name = s.name WHERE test""")
def q6_trend(spark, sf):
    train, test = _sales(spark, sf)
    out = series.forecast_groups(train, test, ["name"], "d", "y", method="additive", log=False, weekly=0, yearly=0, ridge=0.0)
    return out.select("name", "d", r4("prediction").alias("prediction"))


@query("q6_forecast_effect", f"""
WITH {_SALES}, first_days AS (SELECT name, d, y, day(d) = 1 AS feast, test FROM s),
means AS (SELECT name, AVG(y) FILTER (NOT feast) AS plain, AVG(y) FILTER (feast) AS feasts FROM first_days WHERE NOT test GROUP BY name)
SELECT f.name, f.d, round(CASE WHEN feast THEN feasts ELSE plain END, 4) AS prediction FROM first_days f JOIN means m ON m.name = f.name WHERE test""")
def q6_effect(spark, sf):
    """One effect and a level: the mean of the first days of months, and of all other days."""
    train, test = _sales(spark, sf)
    feasts = calendar_of(table(spark, sf, "orders"), "o_orderdate", "d").unionByName(calendar_of(table(spark, sf, "events"), "ts", "d")).distinct()
    effects = forecast.holiday_effects(feasts.filter(F.dayofmonth("d") == 1).withColumn("holiday", F.lit("first")), "d")
    out = series.forecast_groups(train, test, ["name"], "d", "y", method="additive", log=False, weekly=0, yearly=0, ridge=0.0, effects=effects, trend=False)
    return out.select("name", "d", r4("prediction").alias("prediction"))


@query("q7_finish_forecast", f"WITH {_SALES} SELECT name, d, greatest(0.0, round_even(prediction, 0)) AS y FROM naive")
def q7(spark, sf):
    train, test = _sales(spark, sf)
    out = series.forecast_groups(train, test, ["name"], "d", "y", method="seasonal_naive")
    return series.finish_forecast(out, ["name", "d"], "y", digits=0)


@query("q8_transactions_model")
def q8(spark, sf):
    visits = table(spark, sf, "orders").groupBy("o_orderpriority", "o_orderstatus", F.to_date("o_orderdate").alias("d")).agg(
        F.count(F.lit(1)).alias("visits"))
    df = visits.select("*", F.month("d").cast("string").alias("month"), F.date_format("d", "EEEE").alias("day"),
                       F.year("d").cast("double").alias("year"))
    model = models.log_linear(df, "visits", ["year"], ["o_orderpriority", "o_orderstatus", "month", "day"])
    pred = models.log_linear_predict(model, df)
    return windows.group_mean(pred, ["d", "o_orderpriority"], "prediction", 0, "visits_mean").select(
        "o_orderpriority", "o_orderstatus", "d", "visits", "visits_mean")


@query("q9_ranked_correlations", """
WITH f AS (SELECT p_type, CAST(l_shipdate AS DATE) AS d, SUM(l_quantity) AS qty FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1, 2),
o AS (SELECT CAST(o_orderdate AS DATE) AS d, AVG(o_totalprice) AS price FROM orders GROUP BY 1)
SELECT p_type, round(corr(qty, price), 6) AS corr FROM f JOIN o ON o.d = f.d GROUP BY 1""")
def q9(spark, sf):
    part = table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), "p_type")
    sales = table(spark, sf, "lineitem").join(part, "l_partkey").groupBy("p_type", F.to_date("l_shipdate").alias("d")).agg(
        F.sum("l_quantity").alias("qty"))
    price = table(spark, sf, "orders").groupBy(F.to_date("o_orderdate").alias("d")).agg(F.avg("o_totalprice").alias("price"))
    return series.group_correlations(sales.join(price, "d"), ["p_type"], "qty", "price").withColumn("corr", r4("corr", 6))


@query("q10_seasonal_naive", f"WITH {_SALES} SELECT name, d, round(prediction, 4) AS prediction FROM naive")
def q10(spark, sf):
    train, test = _sales(spark, sf)
    out = series.forecast_groups(train, test, ["name"], "d", "y", method="seasonal_naive")
    return out.select("name", "d", r4("prediction").alias("prediction"))


@query("q11_daily_average", """
SELECT CAST(o_orderdate AS DATE) AS d, dayname(o_orderdate) AS day_name, round(AVG(o_totalprice), 6) AS price FROM orders WHERE o_orderdate <= TIMESTAMP '2000-06-30' GROUP BY 1, 2""")
def q11(spark, sf):
    early = table(spark, sf, "orders").filter(F.col("o_orderdate") <= F.lit("2000-06-30").cast("timestamp"))
    return early.groupBy(F.to_date("o_orderdate").alias("d"), F.date_format("o_orderdate", "EEEE").alias("day_name")).agg(
        r4(F.avg("o_totalprice"), 6).alias("price"))


@query("q12_sales_by_kind", """
SELECT c_mktsegment, round(SUM(o_totalprice), 2) AS total FROM orders JOIN customer ON c_custkey = o_custkey
WHERE o_orderdate >= TIMESTAMP '1999-01-01' AND o_orderdate < TIMESTAMP '2000-01-01' GROUP BY 1""")
def q12(spark, sf):
    customer = table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment")
    year = table(spark, sf, "orders").filter(
        (F.col("o_orderdate") >= F.lit("1999-01-01").cast("timestamp")) & (F.col("o_orderdate") < F.lit("2000-01-01").cast("timestamp")))
    return year.join(customer, "o_custkey").groupBy("c_mktsegment").agg(r4(F.sum("o_totalprice"), 2).alias("total"))


@query("q13_holiday_regressors", f"WITH {_HOLIDAYS} SELECT DISTINCT date, locale_name FROM h WHERE type = 'Holiday' AND NOT transferred")
def q13(spark, sf):
    return series.holiday_regressors(_holidays(spark, sf))
