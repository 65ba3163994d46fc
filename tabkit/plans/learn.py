"""Models, scores and recommendations over the test tables."""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.evaluation import MulticlassClassificationEvaluator, RegressionEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.ml.tuning import ParamGridBuilder
from pyspark.sql import functions as F

from tabkit.operators import agg, boosting, linear, metrics, models, recommend
from tabkit.operators.rows import kfold, train_test_split
from tabkit.plans.registry import hash_sql, query, r4, table, unit_sql
from tabkit.sources import sinks, workspace

# ---- model inputs


def _labelled(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "lang", "source", F.log1p("n_chars").alias("size"))
    return table(spark, sf, "labels").join(docs, "doc_id").select(
        "doc_id", "lang", "source", "size", F.col("quality").cast("double").alias("quality"))


def _priced(spark, sf):
    """Orders with customer features and the log of their price."""
    lines = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.count(F.lit(1)).cast("double").alias("n_lines"), F.sum("l_quantity").alias("quantity"))
    customer = table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_acctbal", "c_mktsegment")
    return (table(spark, sf, "orders").join(customer, "o_custkey").join(lines, "o_orderkey", "left")
            .fillna(0.0, ["n_lines", "quantity"])
            .select("o_orderkey", F.log1p("o_totalprice").alias("log_price"), "c_acctbal", "c_mktsegment", "o_orderstatus",
                    F.month("o_orderdate").cast("double").alias("month"), "n_lines", "quantity"))


_NUM, _CAT = ["c_acctbal", "month", "n_lines", "quantity"], ["c_mktsegment", "o_orderstatus"]


def _rmse(y="log_price"):
    return RegressionEvaluator(labelCol=y, metricName="rmse")


def _predicted(pred, cols=("o_orderkey",)):
    return pred.select(*cols, r4("prediction", 6).alias("prediction"))


# ---- models


@query("n1_logit")
def n1(spark, sf):
    _, scored = models.logit(_labelled(spark, sf), "quality", ["size"], ["lang"])
    return scored.select("doc_id", r4("prediction", 6).alias("prediction"), "class")


_LABELLED = "l AS (SELECT doc_id, lang, CAST(quality AS DOUBLE) AS quality FROM labels JOIN documents USING (doc_id))"


@query("n1_logit_factor", f"""
WITH {_LABELLED}, p AS (SELECT lang, AVG(quality) AS p FROM l GROUP BY 1)
SELECT doc_id, round(p, 4) AS prediction, CAST(p > 0.5 AS INTEGER) AS class FROM l JOIN p USING (lang)""")
def n1_factor(spark, sf):
    _, scored = models.logit(_labelled(spark, sf), "quality", [], ["lang"])
    return scored.select("doc_id", r4("prediction").alias("prediction"), "class")


@query("n1_logit_summary", """
WITH l AS (SELECT CASE WHEN doc_id % 2 = 0 THEN 'even' ELSE 'odd' END AS half, CAST(quality AS DOUBLE) AS quality FROM labels JOIN documents USING (doc_id)),
c AS (SELECT half, SUM(quality) AS a, SUM(1 - quality) AS b FROM l GROUP BY 1), base AS (SELECT * FROM c ORDER BY half LIMIT 1),
t AS (SELECT '(Intercept)' AS term, ln(a / b) AS estimate, sqrt(1 / a + 1 / b) AS std_error FROM base
  UNION ALL SELECT 'half' || c.half, ln(c.a / c.b) - ln(base.a / base.b), sqrt(1 / c.a + 1 / c.b + 1 / base.a + 1 / base.b) FROM c, base WHERE c.half <> base.half)
SELECT term, round(estimate, 3) AS estimate, round(std_error, 3) AS std_error, round(estimate / std_error, 3) AS statistic FROM t""")
def n1b(spark, sf):
    df = _labelled(spark, sf).withColumn("half", F.when(F.col("doc_id") % 2 == 0, "even").otherwise("odd"))
    model, _ = models.logit(df, "quality", [], ["half"])
    return models.glm_summary(model, spark).select("term", *[r4(c, 3).alias(c) for c in ("estimate", "std_error", "statistic")])


def _dated_orders(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", "o_totalprice", F.dayofyear("o_orderdate").cast("double").alias("yday"),
                                             "o_orderpriority", "o_orderstatus")


@query("n2_log_linear")
def n2(spark, sf):
    df = _dated_orders(spark, sf)
    model = models.log_linear(df, "o_totalprice", ["yday"], ["o_orderpriority", "o_orderstatus"])
    return models.log_linear_predict(model, df).select("o_orderkey", r4("prediction", 2).alias("prediction"))


@query("n2_log_linear_factor", """
SELECT o_orderkey, round(exp(AVG(ln(1 + o_totalprice)) OVER (PARTITION BY o_orderpriority)) - 1, 2) AS prediction FROM orders""")
def n2_factor(spark, sf):
    df = _dated_orders(spark, sf)
    return models.log_linear_predict(models.log_linear(df, "o_totalprice", [], ["o_orderpriority"]), df).select(
        "o_orderkey", r4("prediction", 2).alias("prediction"))


@query("n3_linear_model")
def n3(spark, sf):
    df = _priced(spark, sf)
    return _predicted(models.linear_model("log_price", _NUM, _CAT).fit(df).transform(df))


@query("n3_linear_summary", """
WITH o AS (SELECT o_orderstatus AS s, o_totalprice / 1000 AS y FROM orders), g AS (SELECT s, COUNT(*) AS n, AVG(y) AS m, var_pop(y) * COUNT(*) AS ss FROM o GROUP BY 1),
v AS (SELECT SUM(ss) / (SUM(n) - COUNT(*)) AS sigma FROM g), base AS (SELECT * FROM g ORDER BY s LIMIT 1),
t AS (SELECT '(Intercept)' AS term, m AS estimate, sqrt(sigma / n) AS std_error FROM base, v
  UNION ALL SELECT 'o_orderstatus' || g.s, g.m - base.m, sqrt(sigma / g.n + sigma / base.n) FROM g, base, v WHERE g.s <> base.s
  UNION ALL SELECT 'again', NULL, NULL)
SELECT term, round(estimate, 4) AS estimate, round(std_error, 4) AS std_error, round(estimate / std_error, 4) AS statistic FROM t""")
def n3_summary(spark, sf):
    """A factor, and a number that it explains: the number comes first and stays, unless it is constant as here."""
    df = table(spark, sf, "orders").select("o_orderstatus", (F.col("o_totalprice") / 1000).alias("y"), F.lit(2.0).alias("again"))
    fit = models.linear_model("y", ["again"], ["o_orderstatus"]).fit(df)
    return models.glm_summary(fit, spark).select("term", *[r4(c).alias(c) for c in ("estimate", "std_error", "statistic")])


@query("n4_lasso_cv")
def n4(spark, sf):
    path = linear.lasso(_priced(spark, sf), "log_price", "o_orderkey", _NUM, _CAT)
    return path.table(spark).select("step", *[r4(c, 6).alias(c) for c in ("penalty", "error", "error_se")], "terms")


@query("n4_lasso_single", """
WITH o AS (SELECT o_totalprice / 1000 AS y, CAST(dayofyear(o_orderdate) AS DOUBLE) AS x FROM orders),
m AS (SELECT covar_pop(x, y) / stddev_pop(x) AS c, stddev_pop(x) AS sd, AVG(x) AS mx, AVG(y) AS my FROM o),
steps AS (SELECT CAST(UNNEST(range(5)) AS INTEGER) AS step),
b AS (SELECT step, abs(c) * pow(10.0, -step) AS penalty, sign(c) * (abs(c) - abs(c) * pow(10.0, -step)) / sd AS slope, mx, my FROM steps, m)
SELECT step, round(penalty, 5) AS penalty, round(slope, 5) AS slope, round(my - slope * mx, 4) AS intercept FROM b""")
def n4_single(spark, sf):
    df = table(spark, sf, "orders").select("o_orderkey", (F.col("o_totalprice") / 1000).alias("y"), F.dayofyear("o_orderdate").cast("double").alias("x"))
    fit = linear.lasso(df, "y", "o_orderkey", ["x"], k=5, n=5)
    rows = [(i, p, float(b[1]) + 0.0, float(b[0])) for i, (p, b) in enumerate(zip(fit.penalties, fit.path))]
    return spark.createDataFrame(rows, "step int, penalty double, slope double, intercept double").select(
        "step", r4("penalty", 5).alias("penalty"), r4("slope", 5).alias("slope"), r4("intercept").alias("intercept"))


@query("n5_forest_classifier")
def n5(spark, sf):
    df = _labelled(spark, sf)
    est = models.forest_classifier("quality", ["size"], ["lang", "source"], trees=20, maxDepth=4, seed=1)
    return est.fit(df).transform(df).select("doc_id", "prediction")


@query("n6_forest_regressor")
def n6(spark, sf):
    df = _priced(spark, sf)
    est = models.forest_regressor("log_price", _NUM, _CAT, trees=10, maxDepth=5, seed=1)
    return _predicted(est.fit(df).transform(df))


@query("n7_gbt_regressor")
def n7(spark, sf):
    df = kfold(_priced(spark, sf), "o_orderkey", 5, 2).withColumn("held_out", F.col("fold") == 0)
    est = models.gbt_regressor("log_price", _NUM, _CAT, rounds=10, rate=0.4, depth=2, valid="held_out", seed=1)
    return _predicted(est.fit(df).transform(df))


@query("n8_gbt_multiclass")
def n8(spark, sf):
    df = table(spark, sf, "embeddings").select("vec_id", F.col("label").cast("double").alias("label"),
                                               array_to_vector(F.col("embedding").cast("array<double>")).alias("features"))
    scored = boosting.softmax_boost(df, "label", "features", rounds=2, depth=2).transform(df)
    return scored.select("vec_id", "prediction", r4(F.array_max("probability"), 6).alias("probability"))


@query("n8_softmax_stump", """
WITH o AS (SELECT o_orderkey, month(o_orderdate) > 6 AS late, CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END AS y FROM orders),
s AS (SELECT y AS c, COUNT(*) / SUM(COUNT(*)) OVER () AS p FROM o GROUP BY 1),
g AS (SELECT late, c, CASE WHEN y = c THEN 1 ELSE 0 END - p AS r, p FROM o, s),
v AS (SELECT late, c, ln(any_value(p)) + 0.5 * 2 / 3 * SUM(r) / SUM(abs(r) * (1 - abs(r))) AS m FROM g GROUP BY 1, 2),
q AS (SELECT late, c, exp(m) / SUM(exp(m)) OVER (PARTITION BY late) AS p FROM v)
SELECT o_orderkey, round(f.p, 6) AS p_f, round(x.p, 6) AS p_o, round(z.p, 6) AS p_p FROM o JOIN q f ON f.late = o.late AND f.c = 0 JOIN q x ON x.late = o.late AND x.c = 1
JOIN q z ON z.late = o.late AND z.c = 2""")
def n8_stump(spark, sf):
    """One round of trees of depth one on one flag: each leaf's step in closed form."""
    df = table(spark, sf, "orders").select("o_orderkey", (F.month("o_orderdate") > 6).cast("double").alias("late"),
                                           F.when(F.col("o_orderstatus") == "F", 0).when(F.col("o_orderstatus") == "O", 1).otherwise(2).alias("y"))
    df = VectorAssembler(inputCols=["late"], outputCol="features").transform(df)
    scored = boosting.softmax_boost(df, "y", rounds=1, depth=1, rate=0.5).transform(df)
    return scored.select("o_orderkey", *[r4(F.get("probability", F.lit(c)), 6).alias(f"p_{name}") for c, name in enumerate("fop")])


@query("n9_grid_search")
def n9(spark, sf):
    rf = RandomForestClassifier(labelCol="quality", seed=1)
    grid = ParamGridBuilder().addGrid(rf.numTrees, [5, 10]).addGrid(rf.maxDepth, [2, 4]).build()
    cv = models.grid_search(models.pipeline(rf, ["size"], ["lang"], one_hot=False), grid, _labelled(spark, sf), "doc_id", 3,
                            MulticlassClassificationEvaluator(labelCol="quality", metricName="accuracy"), seed=4)
    return models.search_results(cv, spark)


@query("n10_cross_val")
def n10(spark, sf):
    return models.cross_val(models.linear_model("log_price", _NUM), _priced(spark, sf), "o_orderkey", 5, _rmse())


@query("n11_random_search")
def n11(spark, sf):
    gbt = GBTRegressor(labelCol="log_price", seed=1, maxIter=3)
    space = {gbt.stepSize: (0.01, 0.5, "log"), gbt.maxDepth: (2, 4, "int"), gbt.subsamplingRate: (0.5, 1.0, "linear")}
    est = models.pipeline(gbt, _NUM)
    return models.search_results(models.random_search(est, space, 3, _priced(spark, sf), "o_orderkey", 2, _rmse(), seed=5), spark)


@query("n11_halving_search")
def n11_halving(spark, sf):
    gbt = GBTRegressor(labelCol="log_price", seed=1, maxIter=3)
    space = {gbt.stepSize: (0.01, 0.5, "log"), gbt.maxDepth: (2, 4, "int")}
    report, _ = models.halving_search(models.pipeline(gbt, _NUM), space, 4, _priced(spark, sf), "o_orderkey", _rmse(), eta=2, seed=5)
    return report


@query("n12_ensemble")
def n12(spark, sf):
    df = _priced(spark, sf)

    def make(weight):
        return models.pipeline(LinearRegression(labelCol="log_price", weightCol=weight, solver="normal"), _NUM)

    out = models.ensemble_predict(models.bootstrap_fit(make, df, "o_orderkey", 5, seed=3), df)
    return out.select("o_orderkey", r4("mean", 6).alias("mean"), r4("sd", 6).alias("sd"))


@query("n13_importances")
def n13(spark, sf):
    model = models.forest_regressor("log_price", _NUM, trees=10, maxDepth=4, seed=1).fit(_priced(spark, sf))
    return models.importances(model, _NUM, spark)


@query("n14_permutation_importance")
def n14(spark, sf):
    df = _priced(spark, sf)
    model = models.forest_regressor("log_price", _NUM, trees=10, maxDepth=4, seed=1).fit(df)
    return models.permutation_importance(model, df, "o_orderkey", "log_price", _NUM, seed=2)


@query("n15_fit_predict")
def n15(spark, sf):
    train, test = train_test_split(_priced(spark, sf), "o_orderkey", 0.8, 6)
    return _predicted(models.fit_predict(models.linear_model("log_price", _NUM, _CAT), train, test))


@query("a14_save_load_model", """
SELECT o_orderkey, round(exp(AVG(ln(1 + o_totalprice)) OVER (PARTITION BY o_orderstatus)) - 1, 2) AS prediction FROM orders""")
def a14(spark, sf):
    df = _dated_orders(spark, sf)
    fitted = models.log_linear(df, "o_totalprice", [], ["o_orderstatus"])
    loaded = sinks.load_model(sinks.save_model(fitted, workspace.new_path(spark, "model")))
    return models.log_linear_predict(loaded, df).select("o_orderkey", r4("prediction", 2).alias("prediction"))


# ---- scores


def _scored(spark, sf):
    """A rule that predicts the status of an order from its price, with class scores."""
    p = F.floor(F.col("o_totalprice") / 1000)
    return table(spark, sf, "orders").select(
        "o_orderkey", "o_orderpriority", "o_totalprice", F.col("o_orderstatus").alias("actual"),
        F.when(p < 150, "F").when(p < 300, "O").otherwise("P").alias("pred"), p.cast("double").alias("s_f"),
        (-p).cast("double").alias("s_o"), F.abs(p - 250).cast("double").alias("s_p"),
        (F.dayofyear("o_orderdate") * 1000.0).alias("guess"))


_SCORED = """s AS (SELECT o_orderkey, o_orderpriority, o_totalprice, o_orderstatus AS actual, CASE WHEN floor(o_totalprice / 1000) < 150 THEN 'F'
 WHEN floor(o_totalprice / 1000) < 300 THEN 'O' ELSE 'P' END AS pred, floor(o_totalprice / 1000) AS s_f, -floor(o_totalprice / 1000) AS s_o,
 abs(floor(o_totalprice / 1000) - 250) AS s_p, dayofyear(o_orderdate) * 1000.0 AS guess FROM orders)"""


@query("o1_rmse", f"WITH {_SCORED} SELECT o_orderpriority, round(sqrt(AVG(pow(o_totalprice - guess, 2))), 3) AS rmse FROM s GROUP BY 1")
def o1(spark, sf):
    return metrics.rmse(_scored(spark, sf), "o_totalprice", "guess", ["o_orderpriority"]).withColumn("rmse", r4("rmse", 3))


@query("o2_mae", f"WITH {_SCORED} SELECT round(AVG(abs(o_totalprice - guess)), 3) AS mae FROM s")
def o2(spark, sf):
    return metrics.mae(_scored(spark, sf), "o_totalprice", "guess").withColumn("mae", r4("mae", 3))


@query("o3_r2", f"WITH {_SCORED} SELECT round(pow(corr(o_totalprice, guess), 2), 8) AS r2 FROM s")
def o3(spark, sf):
    return metrics.r2_corr(_scored(spark, sf), "o_totalprice", "guess").withColumn("r2", r4("r2", 8))


@query("o4_accuracy", f"WITH {_SCORED} SELECT round(AVG(CASE WHEN actual = pred THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM s")
def o4(spark, sf):
    return metrics.accuracy(_scored(spark, sf), "actual", "pred").withColumn("accuracy", r4("accuracy", 6))


@query("o5_confusion", f"""
WITH {_SCORED} SELECT actual, COUNT(*) FILTER (WHERE pred = 'F') AS "F", COUNT(*) FILTER (WHERE pred = 'O') AS "O", COUNT(*) FILTER (WHERE pred = 'P') AS "P" FROM s GROUP BY 1""")
def o5(spark, sf):
    return metrics.confusion(_scored(spark, sf), "actual", "pred", ["F", "O", "P"])


@query("o6_class_report", f"""
WITH {_SCORED}, c AS (SELECT UNNEST(['F', 'O', 'P']) AS class), k AS (SELECT class, COUNT(*) FILTER (WHERE actual = class) AS support,
 COUNT(*) FILTER (WHERE pred = class) AS p, COUNT(*) FILTER (WHERE pred = class AND actual = class) AS t FROM c, s GROUP BY 1),
m AS (SELECT class, COALESCE(t / CAST(NULLIF(p, 0) AS DOUBLE), 0) AS precision, COALESCE(t / CAST(NULLIF(support, 0) AS DOUBLE), 0) AS recall, support FROM k),
f AS (SELECT class, precision, recall, COALESCE(2 * precision * recall / NULLIF(precision + recall, 0), 0) AS f1, support FROM m)
SELECT class, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support FROM f
UNION ALL SELECT 'macro avg', round(AVG(precision), 6), round(AVG(recall), 6), round(AVG(f1), 6), CAST(SUM(support) AS BIGINT) FROM f
UNION ALL SELECT 'weighted avg', round(SUM(precision * support) / SUM(support), 6), round(SUM(recall * support) / SUM(support), 6), round(SUM(f1 * support) / SUM(support), 6), CAST(SUM(support) AS BIGINT) FROM f""")
def o6(spark, sf):
    out = metrics.class_report(_scored(spark, sf), "actual", "pred")
    return out.withColumns({c: r4(c, 6) for c in ("precision", "recall", "f1")})


_AUC = """l AS (SELECT 'F' AS class, s_f AS score, actual = 'F' AS pos FROM s UNION ALL SELECT 'O', s_o, actual = 'O' FROM s UNION ALL SELECT 'P', s_p, actual = 'P' FROM s),
r AS (SELECT class, pos, rank() OVER (PARTITION BY class ORDER BY score) + (COUNT(*) OVER (PARTITION BY class, score) - 1) / 2.0 AS r FROM l),
a AS (SELECT class, (SUM(CASE WHEN pos THEN r END) - CAST(COUNT(*) FILTER (WHERE pos) AS DOUBLE) * (COUNT(*) FILTER (WHERE pos) + 1) / 2.0)
 / (CAST(COUNT(*) FILTER (WHERE pos) AS DOUBLE) * COUNT(*) FILTER (WHERE NOT pos)) AS auc FROM r GROUP BY 1)"""
_SCORES = {"F": "s_f", "O": "s_o", "P": "s_p"}


@query("o7_auc_by_class", f"WITH {_SCORED}, {_AUC} SELECT class, round(auc, 8) AS auc FROM a")
def o7(spark, sf):
    return metrics.auc_by_class(_scored(spark, sf), "actual", _SCORES).withColumn("auc", r4("auc", 8))


@query("o7_auc_ovr", f"WITH {_SCORED}, {_AUC} SELECT round(AVG(auc), 8) AS auc FROM a")
def o7b(spark, sf):
    return metrics.auc_ovr(_scored(spark, sf), "actual", _SCORES).withColumn("auc", r4("auc", 8))


@query("o8_fold_mean", f"""
WITH {_SCORED}, f AS (SELECT floor({unit_sql('o_orderkey', 8)} * 12) AS fold, AVG(pow(o_totalprice - guess, 2)) AS mse FROM s GROUP BY 1)
SELECT round(sqrt(AVG(mse)), 3) AS mse FROM f""")
def o8(spark, sf):
    folded = kfold(_scored(spark, sf), "o_orderkey", 12, 8)
    err = F.col("o_totalprice") - F.col("guess")
    return metrics.fold_mean(folded.groupBy("fold").agg(F.avg(err * err).alias("mse")), "mse", root=True).withColumn("mse", r4("mse", 3))


@query("o9_compare", f"WITH {_SCORED} SELECT o_orderkey, pred AS predicted, actual, pred = actual AS same FROM s")
def o9(spark, sf):
    s = _scored(spark, sf)
    return metrics.compare(s, s, "o_orderkey", "pred", "actual")


# ---- recommendations


def _ratings(spark, sf):
    orders = table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("user"))
    return table(spark, sf, "lineitem").join(orders, "l_orderkey").select(
        "user", F.col("l_partkey").alias("item"), F.col("l_quantity").alias("rating"))


def _items(spark, sf):
    rated = table(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias("item")).agg((F.avg("l_quantity") / 5).alias("rating"))
    return table(spark, sf, "part").select(
        F.col("p_partkey").alias("item"), F.split("p_name", " ").alias("genres"), F.col("p_type").alias("kind"),
        F.col("p_size").alias("episodes")).join(rated, "item")


def _inter(spark, sf):
    return recommend.interactions(_ratings(spark, sf), _items(spark, sf), 8)


_INTER = """inter AS (SELECT o_custkey AS "user", l_partkey AS item, SUM(1.0 + l_quantity + 1 + len(list_distinct(string_split(p_name, ' ')))) AS weight
 FROM orders JOIN lineitem ON o_orderkey = l_orderkey JOIN part ON p_partkey = l_partkey WHERE l_quantity >= 8 GROUP BY 1, 2)"""
_SIM = f"""{_INTER}, c AS (SELECT "user", item, weight - AVG(weight) OVER (PARTITION BY "user") AS v, AVG(weight) OVER (PARTITION BY "user") AS m FROM inter),
p AS (SELECT a.item, b.item AS neighbor, SUM(a.v * b.v) AS vw, sqrt(SUM(a.v * a.v) * SUM(b.v * b.v)) AS norm FROM c a JOIN c b ON a."user" = b."user" AND a.item <> b.item GROUP BY 1, 2),
q AS (SELECT item, neighbor, round(vw / norm, 6) AS similarity FROM p WHERE norm > 1e-12),
sim AS (SELECT * FROM (SELECT item, neighbor, similarity, CAST(row_number() OVER (PARTITION BY item ORDER BY similarity DESC, neighbor) AS INTEGER) AS rank FROM q) WHERE rank <= 50)"""
_REC = f"""{_SIM}, sc AS (SELECT c."user", sim.item, round(SUM(similarity * v) / NULLIF(SUM(abs(similarity)), 0) + any_value(m), 6) AS score FROM c JOIN sim ON sim.neighbor = c.item
 WHERE NOT EXISTS (SELECT 1 FROM inter i WHERE i."user" = c."user" AND i.item = sim.item) GROUP BY 1, 2),
rec AS (SELECT * FROM (SELECT "user", item, score, CAST(row_number() OVER (PARTITION BY "user" ORDER BY score DESC, item) AS INTEGER) AS rank FROM sc WHERE score IS NOT NULL) WHERE rank <= 3)"""


def _kept_inter(spark, sf):
    scratch = workspace.Scratch(spark, "inter")
    ratings = scratch.keep(_ratings(spark, sf), heavy=True)            # the shuffles of one join go before those of the next
    inter = scratch.keep(recommend.interactions(ratings, _items(spark, sf), 8), heavy=True)
    scratch.free(ratings)
    return inter


@query("p1_interactions", f'WITH {_INTER} SELECT "user", item, weight FROM inter')
def p1(spark, sf):
    return _inter(spark, sf)


@query("p2_item_similarity", f"WITH {_SIM} SELECT item, neighbor, similarity + 0.0 AS similarity, rank FROM sim")
def p2(spark, sf):
    out = recommend.item_similarity(_kept_inter(spark, sf), 50)
    return out.withColumn("similarity", F.col("similarity") + 0.0)


def _recommended(spark, sf):
    inter = _kept_inter(spark, sf)
    return recommend.recommend(inter, recommend.item_similarity(inter, 50), 3)


@query("p3_recommend", f'WITH {_REC} SELECT "user", item, round(score, 4) AS score, rank FROM rec')
def p3(spark, sf):
    return _recommended(spark, sf).withColumn("score", r4("score"))


@query("p4_recommended_text", f"""WITH {_REC} SELECT "user", string_agg(CAST(item AS VARCHAR), ', ' ORDER BY rank) AS item FROM rec GROUP BY 1""")
def p4(spark, sf):
    return agg.collect_text(_recommended(spark, sf), ["user"], "item", ["rank"])


_FULL = """w AS (SELECT DISTINCT o_custkey AS u, l_partkey AS i FROM orders JOIN lineitem ON o_orderkey = l_orderkey),
cat AS (SELECT p_partkey AS i, list_distinct(string_split(p_name, ' ')) AS gs, p_type AS t, p_size AS e, r FROM part JOIN (SELECT l_partkey, AVG(l_quantity) / 5 AS r FROM lineitem GROUP BY 1) ON l_partkey = p_partkey),
fl AS (SELECT * FROM w JOIN cat USING (i))"""


@query("p5_user_profile", f"""
WITH {_FULL}, k AS (SELECT u, t, row_number() OVER (PARTITION BY u ORDER BY COUNT(*) DESC, t) AS r FROM fl GROUP BY 1, 2),
g AS (SELECT u, COUNT(DISTINCT g) AS n FROM (SELECT u, UNNEST(gs) AS g FROM fl) GROUP BY 1)
SELECT fl.u AS "user", COUNT(*) AS n_seen, round(AVG(CASE WHEN e = 1 THEN 1.0 ELSE 0.0 END), 6) AS single_share, any_value(k.t) AS modal_kind, any_value(g.n) AS n_genres
FROM fl JOIN k ON k.u = fl.u AND k.r = 1 JOIN g ON g.u = fl.u GROUP BY 1""")
def p5(spark, sf):
    return recommend.user_profile(_ratings(spark, sf), _items(spark, sf)).withColumn("single_share", r4("single_share", 6))


@query("p6_hybrid", f"""
WITH {_FULL}, sg AS (SELECT u, AVG(CASE WHEN e = 1 THEN 1.0 ELSE 0.0 END) >= 0.03 AS single, list_distinct(flatten(list(gs))) AS tastes FROM fl GROUP BY 1),
cells AS (SELECT DISTINCT u, t, 1 AS e FROM fl JOIN sg USING (u) WHERE single UNION SELECT DISTINCT u, t, e + CAST(d AS INTEGER) FROM fl JOIN sg USING (u), (SELECT UNNEST(range(-4, 5)) AS d) WHERE NOT single),
eligible AS (SELECT c.u, g.i, (CAST('0x' || substr({hash_sql('g.i', 0)}, 1, 8) AS BIGINT) - CAST('0x' || substr({hash_sql('c.u', 0)}, 1, 8) AS BIGINT) + 4294967296) % 4294967296 AS ahead
  FROM cells c JOIN sg ON sg.u = c.u JOIN cat g ON g.t = c.t AND g.e = c.e AND g.r >= 5 AND len(list_intersect(g.gs, sg.tastes)) > 0
  WHERE NOT EXISTS (SELECT 1 FROM w WHERE w.u = c.u AND w.i = g.i))
SELECT u AS "user", i AS item FROM (SELECT u, i, row_number() OVER (PARTITION BY u ORDER BY ahead, i) AS r FROM eligible) WHERE r <= 3""")
def p6(spark, sf):
    return recommend.hybrid_recommend(_ratings(spark, sf), _items(spark, sf), 3, min_rating=5.0, single_share=0.03)
