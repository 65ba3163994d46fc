"""Grouped forecasts against dense solvers that see one series at a time."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabkit.operators import forecast, moments, series

START = dt.date(2018, 1, 1)


def arx_by_hand(y, x, x_new, max_order):
    top = min(max_order, len(y) // 3)
    if len(y) < 8 or np.ptp(y) == 0:
        return np.full(len(x_new), y.mean())
    best = None
    for p in range(top + 1):
        design = np.column_stack([np.ones(len(y) - top), x[top:], *[y[top - k:len(y) - k] for k in range(1, p + 1)]])
        if len(design) <= design.shape[1] + 1:
            continue
        beta = np.linalg.lstsq(design, y[top:], rcond=None)[0]
        aic = len(design) * np.log(np.sum((y[top:] - design @ beta) ** 2) / len(design)) + 2 * np.linalg.matrix_rank(design)
        if best is None or aic < best[0]:
            best = aic, p, beta
    past, out = list(y), []
    for row in x_new:
        out.append(np.concatenate([[1.0], row, past[::-1][:best[1]]]) @ best[2])
        past.append(out[-1])
    return np.array(out)


def additive_by_hand(day, y, x, marks, day_new, x_new, marks_new, weekly, yearly, ridge):
    span = max(day[-1] - day[0], 1)
    spread = np.where(x.std(0) > 0, x.std(0), 1.0)

    def design(d, r, m):
        cols = [np.ones(len(d)), (d - day[0]) / span]
        for period, n in ((7.0, weekly), (365.25, yearly if span >= 730.5 else 0)):
            for k in range(1, n + 1):
                cols += [np.sin(2 * np.pi * k * d / period), np.cos(2 * np.pi * k * d / period)]
        return np.column_stack([*cols, (r - x.mean(0)) / spread, m])
    a = design(day, x, marks)
    penalty = ridge * np.eye(a.shape[1])
    penalty[0, 0] = 0
    return design(day_new, x_new, marks_new) @ np.linalg.lstsq(a.T @ a + penalty, a.T @ y, rcond=None)[0]


def panel(spark, lengths, horizon=12, seed=0):
    """Series of given lengths with a week, an autoregressive error, a promotion and a price."""
    rng = np.random.default_rng(seed)
    rows = []
    for k, n in lengths.items():
        e = 0.0
        for i in range(n + horizon):
            promo, price = float(rng.random() < 0.3), 50 + rng.normal()
            e = 0.6 * e + rng.normal()
            rows.append((k, START + dt.timedelta(days=i), 20 + 0.01 * i + 3 * math.sin(2 * math.pi * i / 7) + 2 * promo - 0.3 * price + e, promo, price, i >= n))
    df = spark.createDataFrame(rows, "k string, d date, y double, promo double, price double, new boolean")
    return df.filter("NOT new"), df.filter("new"), rows


def by_key(rows, k):
    mine = [r for r in rows if r[0] == k]
    old, new = [r for r in mine if not r[5]], [r for r in mine if r[5]]
    x = lambda part: np.array([[r[3], r[4]] for r in part])                                   # noqa: E731
    d = lambda part: np.array([(r[1] - dt.date(1970, 1, 1)).days for r in part], float)       # noqa: E731
    return np.array([r[2] for r in old]), x(old), x(new), d(old), d(new)


@pytest.mark.parametrize("span_rows", [2_000_000, 50])
@pytest.mark.parametrize("order", [0, 1, 7])
def test_arx_equals_the_dense_solver(spark, span_rows, order):
    train, test, rows = panel(spark, {"long": 300, "mid": 60, "short": 11, "few": 7, None: 90})
    out = forecast.arx(train, test, ["k"], "d", "y", ["promo", "price"], max_order=order, span_rows=span_rows)
    got = {}
    for r in sorted(out.collect(), key=lambda r: r["d"]):
        got.setdefault(r["k"], []).append(r["prediction"])
    for k in ("long", "mid", "short", "few", None):
        y, x, x_new, _, _ = by_key(rows, k)
        assert np.allclose(got[k], arx_by_hand(y, x, x_new, order), atol=1e-6), k


def test_arx_with_gaps_in_regressors_and_aliased_ones(spark):
    """A regressor twice counts once; rows without one serve as lags only; forecast rows without one take its mean."""
    train, test, rows = panel(spark, {"a": 120})
    twice = [df.withColumns({"again": F.col("promo") * 2, "price": F.when(F.dayofmonth("d") != 5, F.col("price"))}) for df in (train, test)]
    out = forecast.arx(*twice, ["k"], "d", "y", ["promo", "price", "again"])
    assert out.filter("prediction IS NULL OR abs(prediction) > 100").count() == 0 and out.count() == 12
    one = forecast.arx(train, test, ["k"], "d", "y", ["promo", "price"]).collect()
    two = forecast.arx(*[df.withColumn("again", F.col("promo") * 2) for df in (train, test)], ["k"], "d", "y", ["promo", "price", "again"]).collect()
    assert np.allclose(sorted(r["prediction"] for r in one), sorted(r["prediction"] for r in two))


def test_arx_takes_a_series_past_any_task(spark):
    """150,000 rows of one series, in blocks of 20,000: y = 0.5 y' + 1 with noise, far from its start."""
    n = 150_000
    train = spark.range(n + 5).select(
        F.lit("s").alias("k"), F.expr("date_add(DATE'1600-01-01', CAST(id AS INT))").alias("d"),
        (F.sin(F.col("id") * 12.9898) * 43758.5453 % 1.0).alias("y"), F.col("id"))
    out = forecast.arx(train.filter(F.col("id") < n), train.filter(F.col("id") >= n), ["k"], "d", "y", max_order=2, span_rows=20_000)
    y = np.array([r[0] for r in train.filter(F.col("id") < n).orderBy("id").select("y").collect()])
    want = arx_by_hand(y, np.zeros((n, 0)), np.zeros((5, 0)), 2)
    assert np.allclose([r["prediction"] for r in sorted(out.collect(), key=lambda r: r["d"])], want, atol=1e-8)


@pytest.mark.parametrize("ridge", [1.0, 0.0])
def test_additive_equals_the_dense_solver(spark, ridge):
    train, test, rows = panel(spark, {"years": 800, "months": 200, "few": 3}, horizon=40)
    feasts = spark.createDataFrame(
        [(START + dt.timedelta(days=100 * i + s), name, -1, u) for name, s, u in (("fair", 20, 1), ("feast", 21, None), ("once", 500, 0)) for i in range(9 if name != "once" else 1)]
        + [(START, None, 0, 0), (None, "nowhere", 0, 0)], "date date, holiday string, lower int, upper int")
    effects = forecast.holiday_effects(feasts, lower="lower", upper="upper").withColumnRenamed("date", "d")
    on = {r["d"]: r["effects"] for r in effects.collect()}
    names = sorted({e for x in on.values() for e in x})
    assert names == ["fair", "fair_+1", "fair_-1", "feast", "feast_-1", "once", "once_-1"]
    assert max(map(len, on.values())) == 2
    out = forecast.additive(train, test, ["k"], "d", "y", ["promo", "price"], effects, weekly=2, yearly=2, ridge=ridge)
    got = {}
    for r in sorted(out.collect(), key=lambda r: r["d"]):
        got.setdefault(r["k"], []).append(r["prediction"])

    def marks(days):
        return np.array([[float(n in on.get(dt.date(1970, 1, 1) + dt.timedelta(days=int(d)), [])) for n in names] for d in days])
    for k in ("years", "months", "few"):
        y, x, x_new, d, d_new = by_key(rows, k)
        want = np.full(40, y.mean()) if k == "few" else additive_by_hand(d, y, x, marks(d), d_new, x_new, marks(d_new), 2, 2, ridge)
        assert np.allclose(got[k], want, atol=1e-6), k


def test_holiday_effects_lower_the_error(spark):
    """The same panel with feasts that double sales: effects find them."""
    days = [START + dt.timedelta(days=i) for i in range(420)]
    rows = [("a", d, 100.0 + 10 * (d.weekday() == 2) + 100 * (d.day == 10), i >= 390) for i, d in enumerate(days)]
    df = spark.createDataFrame(rows, "k string, d date, y double, new boolean")
    feasts = spark.createDataFrame([(d, "tenth") for d in days if d.day == 10], "d date, holiday string")
    effects = forecast.holiday_effects(feasts, "d")
    train, test = df.filter("NOT new"), df.filter("new")

    def worst(**kw):
        out = series.forecast_groups(train, test, ["k"], "d", "y", [], "additive", log=False, yearly=0, **kw)
        return out.agg(F.max(F.abs(F.col("prediction") - F.col("y")))).first()[0]
    assert worst(effects=effects) < 15 < 80 < worst()


def test_categories_stand_for_their_places(spark):
    train, test, _ = panel(spark, {"a": 100, "b": 90})
    named = [df.withColumn("kind", F.when(F.col("promo") > 0, "yes").otherwise("no")) for df in (train, test)]
    one = series.forecast_groups(*named, ["k"], "d", "y", ["price"], "arx", log=False, categories=["kind"])
    two = series.forecast_groups(train, test, ["k"], "d", "y", ["price", "promo"], "arx", log=False)
    assert one.columns == [*test.columns, "kind", "prediction"]
    pick = lambda out: [r["prediction"] for r in sorted(out.collect(), key=lambda r: (r["k"], r["d"]))]     # noqa: E731
    assert np.allclose(pick(one), pick(two))


def test_empty_panels(spark):
    train, test, _ = panel(spark, {"a": 30})
    for solve in (forecast.arx, forecast.additive):
        assert solve(train.limit(0), test, ["k"], "d", "y").filter("prediction IS NULL").count() == 12
        assert solve(train, test.limit(0), ["k"], "d", "y").count() == 0


def test_elimination_marks_what_others_explain():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(50, 3))
    z = np.column_stack([np.ones(50), x, x[:, 0] - x[:, 1], x @ [1.0, 2.0, 3.0] + rng.normal(size=50)])
    steps = moments.Elimination((z.T @ z)[None])
    for k in range(5):
        steps.take(k)
    want, sse, *_ = np.linalg.lstsq(z[:, :4], z[:, -1], rcond=None)
    assert steps.taken[0].tolist() == [True] * 4 + [False, False]
    assert np.allclose(steps.coefficients[0], [*want, 0.0]) and np.isclose(steps.residual[0], sse[0])
