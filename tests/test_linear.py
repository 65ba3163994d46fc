"""Linear models with factors and the lasso against dense solvers on the design matrix."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabkit.operators import linear, models
from tabkit.operators.linear import LinearModel
from tabkit.sources import sinks, workspace


def data(seed=4, n=400):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        a, b, g, h = 1000 + rng.normal(), rng.normal(), "xyz"[rng.integers(0, 3)], ["p", "q"][rng.integers(0, 2)]
        y = 0.5 * a - 2 * b + {"x": 0, "y": 1, "z": -1}[g] + 0.3 * (h == "q") + rng.normal()
        hit = float(rng.random() < 1 / (1 + math.exp(-(b + {"x": 0, "y": 1, "z": -1}[g]))))
        rows.append((i, a, b, g, h, y, hit))
    return rows


def dense(rows):
    return np.array([[1, r[1], r[2], r[3] == "y", r[3] == "z", r[4] == "q"] for r in rows], float)


COLUMNS = "k long, a double, b double, g string, h string, y double, hit double"


def test_factors_are_coded_against_their_first_level(spark):
    rows = data()
    df = spark.createDataFrame([*rows, (900, None, 0.0, "x", "p", 1.0, 1.0), (901, 1.0, 0.0, None, "p", 1.0, 1.0), (902, 1.0, 0.0, "x", "p", None, 1.0)], COLUMNS)
    fit = LinearModel("y", ["a", "b"], ["g", "h"]).fit(df)
    x, y = dense(rows), np.array([r[5] for r in rows])
    beta, sse, *_ = np.linalg.lstsq(x, y, rcond=None)
    error = np.sqrt(np.diag(np.linalg.inv(x.T @ x)) * sse[0] / (len(y) - 6))
    got = [tuple(r) for r in fit.table(spark).collect()]
    assert [r[0] for r in got] == ["(Intercept)", "a", "b", "gy", "gz", "hq"] and fit.n == 400
    assert np.allclose([r[1] for r in got], beta, atol=1e-6) and np.allclose([r[2] for r in got], error, rtol=1e-5)
    assert got[1][4] < 1e-10 and 0 <= got[5][4] <= 1
    scored = {r["k"]: r["prediction"] for r in fit.transform(df.withColumn("g", F.when(F.col("k") == 5, "new").otherwise(F.col("g")))).collect()}
    assert scored[5] is None and scored[900] is None and scored[901] is None
    assert np.allclose([scored[i] for i in range(400) if i != 5], np.delete(x @ beta, 5), atol=1e-6)


def test_aliased_terms_have_no_estimate(spark):
    df = spark.createDataFrame(data(), COLUMNS).withColumns({"twice": F.col("a") * 2 + 1, "same": F.col("g")})
    fit = LinearModel("y", ["a", "twice", "b"], ["g", "same"]).fit(df)
    known = dict(zip(fit.design.terms, fit.estimate))
    assert [t for t, v in known.items() if v is None] == ["twice", "samey", "samez"]
    plain = LinearModel("y", ["a", "b"], ["g"]).fit(df)
    assert np.allclose([v for v in known.values() if v is not None], plain.estimate, atol=1e-7)
    both = fit.transform(df).select("k", "prediction").join(plain.transform(df).select("k", F.col("prediction").alias("other")), "k")
    assert both.filter("abs(prediction - other) > 1e-6").count() == 0


def test_logistic_model_against_newton(spark):
    rows = data()
    df = spark.createDataFrame(rows, COLUMNS)
    fit, scored = models.logit(df, "hit", ["b"], ["g"])
    x, y = dense(rows)[:, [0, 2, 3, 4]], np.array([r[6] for r in rows])
    beta = np.zeros(4)
    for _ in range(30):
        p = 1 / (1 + np.exp(-x @ beta))
        info = (x * (p * (1 - p))[:, None]).T @ x
        beta += np.linalg.solve(info, x.T @ (y - p))
    assert np.allclose(fit.estimate, beta, atol=1e-5) and np.allclose(fit.std_error, np.sqrt(np.diag(np.linalg.inv(info))), rtol=1e-4)
    assert fit.deviance == pytest.approx(-2 * np.sum(y * np.log(p) + (1 - y) * np.log(1 - p)), rel=1e-6) and not fit.separated
    got = [r["prediction"] for r in sorted(scored.collect(), key=lambda r: r["k"])]
    assert np.allclose(got, p, atol=1e-5)


def test_separated_classes_end(spark):
    df = spark.createDataFrame([(i, float(i), float(i >= 10)) for i in range(20)], "k long, a double, hit double")
    fit, scored = models.logit(df, "hit", ["a"])
    assert scored.filter("class <> hit").count() == 0


def test_weights_stand_for_repeated_rows(spark):
    rows = data(n=60)
    df = spark.createDataFrame(rows, COLUMNS).withColumn("w", (F.col("k") % 3).cast("double"))
    once = LinearModel("y", ["a", "b"], ["g"], weight="w").fit(df)
    repeated = LinearModel("y", ["a", "b"], ["g"]).fit(df.withColumn("i", F.explode(F.sequence(F.lit(1), F.lit(2)))).filter("i <= w"))
    assert np.allclose(once.estimate, repeated.estimate, atol=1e-7)


def test_models_are_saved_whole(spark):
    df = spark.createDataFrame(data(), COLUMNS).withColumn("y", F.abs("y"))
    fit = models.log_linear(df, "y", ["a"], ["g"])
    loaded = sinks.load_model(sinks.save_model(fit, workspace.new_path(spark, "linear")))
    assert loaded == fit
    assert [r["prediction"] for r in loaded.transform(df).collect()] == [r["prediction"] for r in fit.transform(df).collect()]


def test_nothing_to_fit(spark):
    df = spark.createDataFrame([], COLUMNS)
    for family in ("gaussian", "binomial"):
        with pytest.raises(ValueError, match="no complete rows"):
            LinearModel("y", ["a"], ["g"], family).fit(df)
    with pytest.raises(ValueError, match="no complete rows"):
        linear.lasso(df, "y", "k", ["a"])


def test_lasso_meets_its_conditions_and_errors_are_those_of_the_folds(spark):
    rows = data()
    df = spark.createDataFrame(rows, COLUMNS).withColumn("flat", F.lit(3.0))
    fit = linear.lasso(df, "y", "k", ["a", "b", "flat"], ["g", "h"], k=7, n=12, ratio=1e-3, seed=3)
    x, y = dense(rows), np.array([r[5] for r in rows])
    x = np.column_stack([x[:, 1:3], np.full(len(y), 3.0), x[:, 3:]])
    sd = np.where(x.std(0) > 0, x.std(0), 1)

    def conditions(x, y, beta, penalty):
        slope = (x - x.mean(0)).T @ (y - beta[0] - x @ beta[1:]) / len(y) / sd
        active = np.abs(beta[1:]) > 0
        return np.allclose(slope[active], penalty * np.sign(beta[1:][active]), atol=1e-5) and (np.abs(slope[~active]) <= penalty + 1e-6).all()
    assert (fit.path[0, 1:] == 0).all() and (fit.path[:, 3] == 0).all()
    for penalty, beta in zip(fit.penalties, fit.path):
        assert conditions(x, y, beta, penalty)
    from tabkit.operators.rows import kfold
    fold = {r["k"]: r["fold"] for r in kfold(df, "k", 7, 3).collect()}
    folds = np.array([fold[i] for i in range(len(y))])
    step, total = 5, 0.0
    for f in range(7):
        inside, out = folds != f, folds == f
        xs, m = x[inside], x[inside].mean(0)
        s = np.where(xs.std(0) > 1e-12, xs.std(0), 1)
        z, target, beta = (xs - m) / s, y[inside] - y[inside].mean(), np.zeros(x.shape[1])
        for _ in range(3000):
            for j in range(x.shape[1]):
                part = z[:, j] @ (target - z @ beta) / len(z) + beta[j]
                beta[j] = np.sign(part) * max(abs(part) - fit.penalties[step], 0) if z[:, j].any() else 0.0
        total += np.sum((y[out] - y[inside].mean() - ((x[out] - m) / s) @ beta) ** 2)
    assert fit.error[step] == pytest.approx(total / len(y), rel=1e-5)
    assert fit.best == int(np.argmin(fit.error)) and fit.fit_at().transform(df).count() == 400


def test_lasso_over_fifty_folds(spark):
    fit = linear.lasso(spark.createDataFrame(data(), COLUMNS), "y", "k", ["a", "b"], ["g", "h"])
    assert len(fit.penalties) == 100 and fit.table(spark).count() == 100
    assert fit.error[fit.best] < 1.3 < fit.error[0]
