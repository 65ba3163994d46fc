"""Imputation, neighbours, encoding and statistics against brute force and known values."""

import math

import numpy as np
import pytest
from pyspark.ml import Pipeline
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from tabkit.functions import numerics as N
from tabkit.operators import encode, impute, neighbors, outliers, stats
from tabkit.operators.neighbors import knn_join
from tests.conftest import rows

# ---- tail functions


def test_tail_functions_match_tables():
    assert N.t_two_sided(2.228139, 10) == pytest.approx(0.05, abs=1e-6)
    assert N.f_tail(4.964603, 1, 10) == pytest.approx(0.05, abs=1e-6)
    assert N.f_tail(2.866081, 4, 20) == pytest.approx(0.05, abs=1e-6)
    assert N.t_quantile(0.975, 10) == pytest.approx(2.228139, abs=1e-6)
    assert N.z_two_sided(1.959964) == pytest.approx(0.05, abs=1e-6)
    assert N.betainc(2, 3, 0.4) == pytest.approx(0.5248, abs=1e-9)
    assert N.f_tail(float("inf"), 1, 2) == 0.0 and math.isnan(N.t_two_sided(float("nan"), 3))


def test_binomial_known_answers():
    assert N.binomial_interval(72, 218) == pytest.approx((0.2682, 0.3970), abs=5e-5)
    assert N.binomial_two_sided(72, 218, 0.5) == pytest.approx(6.03e-7, rel=2e-3)
    assert N.binomial_interval(50, 107) == pytest.approx((0.3702, 0.5662), abs=5e-5)
    assert N.binomial_two_sided(50, 107, 0.5) == pytest.approx(0.5621, abs=5e-5)
    assert N.binomial_interval(0, 5)[0] == 0.0 and N.binomial_interval(5, 5)[1] == 1.0


@pytest.mark.parametrize("p", [0.5, 0.3, 0.05])
def test_binomial_against_full_sum(p):
    for n in (1, 7, 40):
        pmf = [math.comb(n, k) * p ** k * (1 - p) ** (n - k) for k in range(n + 1)]
        for x in range(n + 1):
            want = sum(v for v in pmf if v <= pmf[x] * (1 + 1e-7))
            assert N.binomial_two_sided(x, n, p) == pytest.approx(want, rel=1e-9)


def test_normal_quantile_expression(spark):
    df = spark.createDataFrame([(0.001,), (0.2,), (0.5,), (0.975,), (0.9999,)], "p double")
    got = [r[0] for r in df.select(F.expr(N.normal_quantile_sql("p"))).collect()]
    assert got == pytest.approx([-3.090232, -0.841621, 0.0, 1.959964, 3.719016], abs=1e-5)


def test_binom_test_per_group(spark):
    df = spark.createDataFrame([("c3", int(i < 72)) for i in range(218)] + [("c1", int(i < 50)) for i in range(107)] + [("x", None)],
                               "g string, f int")
    got = {r["g"]: r for r in stats.binom_test(df, ["g"], "f").collect()}
    assert set(got) == {"c1", "c3"} and got["c3"]["low"] == pytest.approx(0.2682, abs=5e-5)


# ---- nearest neighbours


def _points(n, d, seed, clumps=True):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d))
    if clumps:
        x[: n // 3] = x[0]            # a third of all rows are one point
    return [(int(i), [float(v) for v in r], "ab"[i % 2]) for i, r in enumerate(x)]


@pytest.mark.parametrize("within,cell,block", [(None, 1024, 4096), (None, 20, 16), ("g", 20, 16), ("g", 5, 4096)])
def test_knn_join_against_brute_force(spark, within, cell, block):
    pts = [(i, x, None if i % 7 == 0 else g) for i, x, g in _points(150, 3, 1)]
    df = spark.createDataFrame(pts, "k bigint, x array<double>, g string")
    got = knn_join(df, df.withColumnRenamed("k", "n"), "k", "n", "x", 4, within=within, exclude_same=True, cell_rows=cell, block_rows=block)
    got = {(r["k"], r["rank"]): (r["n"], round(r["distance"], 9)) for r in got.collect()}
    for k, x, g in pts:
        near = sorted((round(float(np.linalg.norm(np.array(x) - np.array(y))), 9), j) for j, y, h in pts
                      if j != k and (within is None or h == g))[:4]
        for i, (d, j) in enumerate(near, 1):
            assert got[(k, i)] == (j, d)


def test_knn_join_with_masked_queries(spark):
    """Queries that lack columns share the join; base rows that lack one, and rows without features, take no part."""
    pts = _points(300, 4, 2, clumps=False)
    rng = np.random.default_rng(4)
    asked = [(i, [None if rng.random() < 0.4 else v for v in x]) for i, x, _ in pts] + [(900, None), (901, [None] * 4)]
    base = [(j, x) for j, x, _ in pts] + [(902, [1.0, None, 0.0, 0.0]), (903, None)]
    got = knn_join(spark.createDataFrame(asked, "k long, x array<double>"), spark.createDataFrame(base, "n long, x array<double>"), "k", "n", "x", 3,
                   cell_rows=10, block_rows=50)
    got = {(r["k"], r["rank"]): (r["n"], round(r["distance"], 9)) for r in got.collect()}
    assert len(got) == 3 * 301 and [got[901, i][0] for i in (1, 2, 3)] == [0, 1, 2]
    for k, x in asked[:300]:
        near = sorted((round(math.sqrt(sum((a - b) ** 2 for a, b in zip(x, y) if a is not None)), 9), j) for j, y, _ in pts)[:3]
        assert [got[k, i] for i in (1, 2, 3)] == [(j, d) for d, j in near]


def test_knn_join_visits_far_cells_only_where_needed():
    """On a line, a query opens less than one other cell in its second round."""
    rng = np.random.default_rng(8)
    x = np.sort(rng.random((4000, 1)), axis=0)
    tree = neighbors.PivotTree(x[rng.permutation(4000)[:64]])
    cell, r = tree.home(x)
    n, low, high = (np.array([f(r[cell == c]) if (cell == c).any() else 0 for c in range(64)]) for f in (len, np.min, np.max))
    tree.measured(np.arange(64), n, low, high)
    near = tree.near(x, 3)
    bound = np.sort(np.abs(x - x.T), axis=1)[:, 3]
    far = tree.far(x, bound, near)
    assert sum(map(len, far)) < len(x)                     # of 63 others each
    for i in rng.permutation(4000)[:50]:
        assert set(cell[np.abs(x[:, 0] - x[i, 0]) <= bound[i]]) <= set(near[i]) | set(far[i])


def test_knn_join_few_rows(spark):
    df = spark.createDataFrame([(1, [0.0]), (2, [1.0])], "k int, x array<double>")
    got = knn_join(df, df.withColumnRenamed("k", "n"), "k", "n", "x", 5, exclude_same=True)
    assert rows(got.select("k", "n")) == [(1, 2), (2, 1)]
    assert knn_join(df, df.withColumnRenamed("k", "n").filter("1=0"), "k", "n", "x", 5).count() == 0


def test_knn_impute_patterns(spark):
    rng = np.random.default_rng(3)
    data = [(i, float(a), float(a * 2 + b), float(b)) for i, (a, b) in enumerate(rng.normal(size=(80, 2)))]
    holed = [(i, None if i % 9 == 1 else a, None if i % 7 == 2 else b, c) for i, a, b, c in data]
    df = spark.createDataFrame(holed, "k int, a double, b double, c double")
    out = {r["k"]: r for r in impute.knn_impute(df, "k", ["a", "b", "c"], 5).collect()}
    full = [r for r in holed if None not in r]
    cols = np.array([[np.nan if v is None else v for v in r[1:]] for r in holed], float)
    m, s = np.nanmean(cols, axis=0), np.nanstd(cols, axis=0, ddof=1)
    for i, *v in holed:
        for c in range(3):
            if v[c] is not None:
                assert out[i][c + 1] == v[c]
                continue
            have = [j for j in range(3) if v[j] is not None]
            near = sorted((math.dist([(v[j] - m[j]) / s[j] for j in have], [(r[1 + j] - m[j]) / s[j] for j in have]), r[0], r[1 + c])
                          for r in full)[:5]
            w = [math.exp(-d) for d, _, _ in near]
            assert out[i][c + 1] == pytest.approx(sum(a * b[2] for a, b in zip(w, near)) / sum(w))


# ---- imputation


def test_statistics_impute(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", None), ("a", 4.0), ("b", None), ("b", 9.0), ("c", None)], "k string, v double")
    assert rows(impute.impute(df, ["v"], "mean", ["k"])) == [("a", 1.0), ("a", 2.5), ("a", 4.0), ("b", 9.0), ("b", 9.0), ("c", None)]
    assert sorted(r[1] for r in impute.impute(df, ["v"], "median").collect()) == [1.0, 4.0, 4.0, 4.0, 4.0, 9.0]
    assert impute.impute(df.withColumn("v", F.lit(None).cast("double")), ["v"], "median").filter("v IS NULL").count() == 6


@pytest.fixture(scope="module")
def gappy(spark):
    rng = np.random.default_rng(7)
    data = []
    for s in ("p", "q"):
        for i, v in enumerate(rng.normal(size=60).cumsum()):
            data.append((s, i, None if i < 2 or i > 56 or rng.random() < 0.4 else float(v)))
    data += [("one", i, 3.0 if i == 2 else None) for i in range(5)] + [("two", i, {1: 2.0, 3: 6.0}.get(i)) for i in range(5)]
    data += [("none", i, None) for i in range(3)]
    return spark.createDataFrame(data, "s string, i int, v double").cache()


@pytest.mark.parametrize("how", ["linear", "pchip"])
def test_interpolation_stays_between_known_points(gappy, how):
    out = impute.interpolate(gappy, ["s"], ["i"], "v", how)
    blocks = impute.interpolate(gappy, ["s"], ["i"], "v", how, span_rows=6)
    known = {(r["s"], r["i"]): r["v"] for r in gappy.collect()}
    got = {(r["s"], r["i"]): r["v"] for r in out.collect()}
    assert got.keys() == known.keys()
    for r in blocks.collect():
        assert r["v"] == pytest.approx(got[(r["s"], r["i"])]) or (r["v"] is None and r["s"] == "none")
    for (s, i), v in got.items():
        ks = sorted(j for (t, j), w in known.items() if t == s and w is not None)
        if not ks:
            assert v is None
            continue
        lo = max([j for j in ks if j <= i], default=ks[0])
        hi = min([j for j in ks if j >= i], default=ks[-1])
        a, b = sorted((known[(s, lo)], known[(s, hi)]))
        assert a - 1e-9 <= v <= b + 1e-9
    assert got[("two", 2)] == 4.0 and got[("one", 0)] == 3.0


def test_spline_reproduces_cubics(spark):
    cubic = lambda t: 2.0 - t + 0.5 * t ** 2 - 0.01 * t ** 3
    df = spark.createDataFrame([("a", i, cubic(i + 1) if 3 <= i <= 20 and i % 3 else None) for i in range(25)], "s string, i int, v double")
    for r in impute.interpolate(df, ["s"], ["i"], "v", "spline").collect():
        assert r["v"] == pytest.approx(cubic(r["i"] + 1), abs=1e-8)


def dense_spline(x, y, at):
    """The whole system at once: second derivatives of an interpolating cubic with free end cubics."""
    n = len(x)
    if n < 4:
        return np.polyval(np.polyfit(x, y, n - 1), at) if n else np.full(len(at), np.nan)
    h, m = np.diff(x), np.zeros((n, n))
    slope = np.diff(y) / h
    rhs = np.concatenate([[0], np.diff(slope), [0]])
    for i in range(1, n - 1):
        m[i, i - 1:i + 2] = h[i - 1], 2 * (h[i - 1] + h[i]), h[i]
    third = lambda i: np.polyfit(x[i:i + 4] - x[i], y[i:i + 4], 3)[0]                          # noqa: E731
    m[0, :2], rhs[0] = (-h[0], h[0]), h[0] ** 2 * third(0)
    m[-1, -2:], rhs[-1] = (h[-1], -h[-1]), -h[-1] ** 2 * third(n - 4)
    s = np.linalg.solve(m, rhs)
    i = np.clip(np.searchsorted(x, at, side="right") - 1, 0, n - 2)
    t = at - x[i]
    return y[i] + t * (slope[i] - h[i] * (2 * s[i] + s[i + 1]) + t * (3 * s[i] + t * (s[i + 1] - s[i]) / h[i]))


@pytest.mark.parametrize("span_rows", [2_000_000, 7])
def test_spline_of_any_length(spark, span_rows):
    """Stretches of seven points give what the dense system gives, for series of any number of points."""
    rng = np.random.default_rng(7)
    series = {f"s{n}": sorted(rng.choice(np.arange(1, 2 * n + 6), n, replace=False)) for n in (0, 1, 2, 3, 4, 5, 7, 8, 14, 15, 60)}
    series[None] = [2, 3, 5, 9, 10]
    data = [(s, i, float(rng.normal()) if i in at else None) for s, at in series.items() for i in range(1, 2 * len(at) + 8)]
    df = spark.createDataFrame(data, "s string, i int, v double")
    got = {(r["s"], r["i"]): r["v"] for r in impute.interpolate(df, ["s"], ["i"], "v", "spline", span_rows=span_rows).collect()}
    for s, at in series.items():
        known = {i: v for k, i, v in data if k == s and v is not None}
        want = dense_spline(np.array(sorted(known), float), np.array([known[i] for i in sorted(known)]), np.arange(1, 2 * len(at) + 8, dtype=float))
        mine = [got[s, i] for i in range(1, 2 * len(at) + 8)]
        assert (mine == [None] * len(mine)) if not at else np.allclose(mine, want, rtol=1e-7, atol=1e-7), s


def test_chained_impute_uses_observed_values(spark):
    rng = np.random.default_rng(5)
    a = rng.normal(size=120)
    data = [(i, float(x), None if i % 6 == 0 else round(float(3 * x + 0.01 * rng.normal()), 6)) for i, x in enumerate(a)]
    df = spark.createDataFrame(data, "k int, a double, b double")
    out = impute.chained_impute(df, "k", ["a", "b"], m=2, iters=2)
    assert out.count() == 240 and out.filter("b IS NULL").count() == 0
    seen = {b for _, _, b in data if b is not None}
    for r in out.filter("k % 6 = 0").collect():
        assert r["b"] in seen and abs(r["b"] - 3 * r["a"]) < 1.5
    one = impute.chained_impute(df, "k", ["a", "b"], m=1, iters=1)
    assert rows(one) == rows(impute.chained_impute(df, "k", ["a", "b"], m=1, iters=1, span_rows=25))


def test_posterior_draws_spread_like_the_estimates():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(60, 2)) + [5, -3]
    y = 1 + x @ [2.0, -1.0] + rng.normal(size=60)
    z = np.column_stack([np.ones(60), x])
    beta, sse, *_ = np.linalg.lstsq(z, y, rcond=None)
    c = np.column_stack([np.ones(60), x - x.mean(0)])
    fit = stats.Fit("y", ["a", "b"], 60, x.mean(0), beta, np.linalg.inv(c.T @ c), float(sse[0]), 0.0)
    draws = np.array([impute.posterior_draw(fit, np.random.default_rng([3, i])).beta for i in range(4000)])
    cover = np.linalg.inv(z.T @ z) * sse[0] / 57
    assert np.allclose(draws.mean(0), beta, atol=4 * np.sqrt(np.diag(cover) / 4000).max())
    assert np.allclose(np.cov(draws.T), cover * 57 / 55, rtol=0.25, atol=2e-3)


def test_chained_impute_takes_the_nearest_donor(spark):
    """One gap: its donor is the row whose fitted value is nearest to what the drawn coefficients predict."""
    rng = np.random.default_rng(9)
    a = rng.normal(size=80)
    b = [float(v) for v in 2 * a + rng.normal(size=80)]
    df = spark.createDataFrame([(i, float(x), None if i == 40 else b[i]) for i, x in enumerate(a)], "k int, a double, b double")
    out = impute.chained_impute(df, "k", ["a", "b"], m=4, iters=1, seed=5)
    known = np.arange(80) != 40
    z = np.column_stack([np.ones(79), a[known]])
    beta, sse, *_ = np.linalg.lstsq(z, np.array(b)[known], rcond=None)
    c = a[known] - a[known].mean()
    fit = stats.Fit("b", ["a"], 79, np.array([a[known].mean()]), beta, np.diag([1 / 79, 1 / (c @ c)]), float(sse[0]), 0.0)
    want = []
    for i in range(4):
        drawn = impute.posterior_draw(fit, np.random.default_rng([5, i, 0, 0])).beta
        want.append(np.array(b)[known][np.argmin(np.abs(z @ beta - drawn @ [1, a[40]]))])
    got = {r["imputation"]: r["b"] for r in out.filter("k = 40").collect()}
    assert [got[i + 1] for i in range(4)] == want and len(set(want)) > 1


def test_impute_by_model(spark):
    df = spark.createDataFrame([(i, float(i), None if i % 5 == 0 else 2.0 * i + 1) for i in range(50)], "k int, x double, y double")
    est = Pipeline(stages=[VectorAssembler(inputCols=["x"], outputCol="features"), LinearRegression(solver="normal")])
    for r in impute.impute_by_model(df, "k", "y", est).collect():
        assert r["y"] == pytest.approx(2.0 * r["x"] + 1, abs=1e-6)


def test_outliers(spark):
    df = spark.createDataFrame([("a", float(v)) for v in [1, 2, 1, 2, 1, 2, 1, 2, 1, 2, 1, 2, 1, 2, 100]] + [("b", 5.0)], "k string, v double")
    flags = outliers.flag_outliers(df, ["v"], by=["k"])
    assert [r["v"] for r in flags.filter("v_outlier").collect()] == [100.0]
    fixed = outliers.replace_outliers(df, ["v"], ["k"])
    assert fixed.agg(F.max(F.when(F.col("k") == "a", F.col("v")))).first()[0] == 2.0 and fixed.count() == 16
    assert outliers.iqr_filter(df, "v").filter("v = 100").count() == 0


# ---- encoders


def test_label_codes_are_dense(spark):
    df = spark.createDataFrame([("b",), ("a",), (None,), ("c",), ("a",)], "c string")
    enc = encode.label_encoder(df, "c")
    assert rows(enc.apply(df).select("c", "c_code")) == [("a", 0), ("a", 0), ("b", 1), ("c", 2), (None, None)]
    assert rows(encode.label_encoder(df, "c", span_rows=2).table) == rows(enc.table)


def test_scalers_on_constant_column(spark):
    df = spark.createDataFrame([(1.0, 5.0), (2.0, 5.0), (4.0, 5.0)], "a double, b double")
    z = encode.standard_scaler(df, ["a", "b"]).apply(df)
    assert [r["b"] for r in z.collect()] == [0.0] * 3
    assert z.agg(F.stddev_pop("a")).first()[0] == pytest.approx(1.0)
    assert sorted(r["a"] for r in encode.robust_scaler(df, ["a", "b"]).apply(df).collect()) == pytest.approx([-2 / 3, 0, 4 / 3])


def test_box_cox_finds_the_exponent(spark):
    rng = np.random.default_rng(11)
    df = spark.createDataFrame([(float(np.exp(v)) - 1,) for v in rng.normal(2, 0.3, size=3000)], "v double")
    lam = encode.box_cox_lambda(df, ["v"], refine=2)["v"]
    x = np.array([r[0] for r in df.collect()]) + 1

    def llf(t):
        y = np.log(x) if abs(t) < 1e-12 else (x ** t - 1) / t
        return (t - 1) * np.log(x).sum() - len(x) / 2 * np.log(y.var())
    assert abs(lam) < 0.25 and llf(lam) >= max(llf(lam - 0.002), llf(lam + 0.002)) - 1e-9
    assert encode.box_cox(df, ["v"], {"v": 0.0}).first()[0] == pytest.approx(math.log(x[0]))


def test_james_stein_guards(spark):
    one = spark.createDataFrame([("a", 1.0), ("a", 3.0)], "c string, y double")
    new = spark.createDataFrame([("a",), ("zz",), (None,)], "c string")
    assert [r[1] for r in encode.james_stein(one, "c", "y").apply(new).collect()] == [2.0, 2.0, 2.0]
    many = spark.createDataFrame([(c, float(v)) for c, vs in {"a": (1, 2), "b": (9, 11), "c": (5,), "d": (4, 6), "e": (5, 5)}.items() for v in vs],
                                 "c string, y double")
    got = dict(rows(encode.james_stein(many, "c", "y").table))
    ys = [1, 2, 9, 11, 5, 4, 6, 5, 5]
    v = np.var(ys, ddof=1)
    s = 1 - 0.5 / (0.5 + v) * 2 / 4
    assert got["a"] == pytest.approx(s * 1.5 + (1 - s) * np.mean(ys)) and got["c"] == pytest.approx(5.0)


def test_fitted_tables_apply_to_a_stream(spark, tmp_path):
    df = spark.createDataFrame([("a", 1.0), ("b", 3.0), ("b", 5.0)], "c string, v double")
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("c string, v double").parquet(str(tmp_path / "in"))
    out = encode.label_encoder(df, "c").apply(encode.standard_scaler(df, ["v"]).apply(stream))
    q = out.writeStream.format("memory").queryName("applied").start()
    q.processAllAvailable()
    q.stop()
    assert rows(spark.table("applied").select("c", "c_code")) == [("a", 0), ("b", 1), ("b", 1)]


def test_rare_and_unseen_levels(spark):
    train = spark.createDataFrame([("a",)] * 30 + [("b",)] * 10 + [("c",)], "c string")
    test = spark.createDataFrame([("a",), ("c",), ("new",), (None,)], "c string")
    assert rows(encode.lump_rare(train, "c", 0.05).apply(test)) == [("Other",), ("Other",), ("a",), (None,)]
    assert rows(encode.align_levels(train, test, "c")) == [("a",), ("a",), ("c",), (None,)]


def test_smote_balances_and_interpolates(spark):
    rng = np.random.default_rng(2)
    pts = [(i, lab, [float(v) for v in rng.normal(size=2)]) for i, lab in enumerate([0] * 40 + [1] * 12 + [2] * 7)]
    df = spark.createDataFrame(pts, "k int, y int, x array<double>")
    new = encode.smote(df, "y", "k", "x", k=5, seed=1).collect()
    counts = {lab: sum(r["y"] == lab for r in new) for lab in range(3)}
    assert counts == {0: 0, 1: 28, 2: 33}
    where = {k: (lab, np.array(x)) for k, lab, x in pts}
    for r in new:
        (la, a), (lb, b), p = where[r["k"]], where[r["neighbor"]], np.array(r["x"])
        assert la == lb == r["y"] and np.linalg.norm(p - a) + np.linalg.norm(p - b) == pytest.approx(np.linalg.norm(a - b))
    assert len({(r["k"], r["copy"]) for r in new}) == len(new)


def test_isomap_unrolls_a_curve(spark):
    t = np.linspace(0, 3 * np.pi / 2, 60)
    df = spark.createDataFrame([(i, [float(math.cos(v)), float(math.sin(v))]) for i, v in enumerate(t)], "k int, x array<double>")
    got = {r["k"]: r["iso_1"] for r in encode.landmark_isomap(df, "k", "x", 1, n_neighbors=2, n_landmarks=6).collect()}
    assert abs(np.corrcoef([got[i] for i in range(60)], t)[0, 1]) > 0.999


def test_isomap_joins_separate_parts(spark):
    data = [(i, [float(i), 0.0]) for i in range(8)] + [(i + 8, [float(i), 100.0]) for i in range(8)]
    df = spark.createDataFrame(data, "k int, x array<double>")
    got = encode.landmark_isomap(df, "k", "x", 1, n_neighbors=2, n_landmarks=4)
    assert got.count() == 16 and got.filter("iso_1 IS NULL").count() == 0


# ---- statistics


@pytest.fixture(scope="module")
def regression(spark):
    rng = np.random.default_rng(9)
    x = np.column_stack([rng.normal(1000, 5, 200), rng.normal(0, 1, 200), rng.uniform(0, 1e-3, 200)])
    y = 3 + 0.5 * x[:, 0] - 2 * x[:, 1] + 700 * x[:, 2] + rng.normal(0, 0.3, 200)
    y[17] += 8
    df = spark.createDataFrame([(i, *map(float, r), float(v)) for i, (r, v) in enumerate(zip(x, y))],
                               "k int, a double, b double, c double, y double")
    return df, np.column_stack([np.ones(200), x]), y


def test_ols_matches_normal_equations(spark, regression):
    df, x, y = regression
    fit = stats.ols(df, "y", ["a", "b", "c"])
    beta, *_ = np.linalg.lstsq(x, y, rcond=None)
    res = y - x @ beta
    se = np.sqrt(np.diag(np.linalg.inv(x.T @ x)) * (res @ res) / 196)
    assert fit.beta == pytest.approx(beta, rel=1e-7)
    assert fit.standard_errors() == pytest.approx(se, rel=1e-6)
    assert fit.r2 == pytest.approx(1 - res @ res / ((y - y.mean()) @ (y - y.mean())))
    table = {r["term"]: r for r in fit.coefficients(spark).collect()}
    assert table["b"]["p_value"] < 1e-10 and table["b"]["low"] < beta[2] < table["b"]["high"]
    ml = {r["term"]: r for r in stats.path_model(df, "y", ["a", "b", "c"]).collect()}
    assert ml["a"]["std_error"] == pytest.approx(se[1] * math.sqrt(196 / 200), rel=1e-6)


def test_influence_matches_hat_matrix(regression):
    df, x, y = regression
    fit = stats.ols(df, "y", ["a", "b", "c"])
    hat = np.diag(x @ np.linalg.inv(x.T @ x) @ x.T)
    beta, *_ = np.linalg.lstsq(x, y, rcond=None)
    e = y - x @ beta
    s2 = e @ e / 196
    r = e / np.sqrt(s2 * (1 - hat))
    got = sorted(stats.influence(fit, df).collect(), key=lambda q: q["k"])
    assert [q["hat"] for q in got] == pytest.approx(hat, abs=1e-7)
    assert [q["cook"] for q in got] == pytest.approx(r ** 2 * hat / (4 * (1 - hat)), abs=1e-6)
    assert [q["rstudent"] for q in got] == pytest.approx(r * np.sqrt(195 / (196 - r ** 2)), abs=1e-5)
    top = stats.outlier_test(fit, df).collect()
    assert [q["k"] for q in top] == [17] and top[0]["bonferroni_p"] < 1e-6


def test_ols_refuses_constant_columns(spark):
    df = spark.createDataFrame([(float(i), 1.0, float(i)) for i in range(10)], "a double, b double, y double")
    with pytest.raises(ValueError):
        stats.ols(df, "y", ["a", "b"])


def test_vif_of_three_columns(spark, regression):
    df, x, _ = regression
    inv = np.linalg.inv(np.corrcoef(x[:, 1:].T))
    got = {r["column"]: r["vif"] for r in stats.vif(df, ["a", "b", "c"]).collect()}
    assert [got[c] for c in "abc"] == pytest.approx(np.diag(inv))


def test_anova_tail_and_constant_factor(spark):
    df = spark.createDataFrame([("u", "k", 1.0), ("u", "k", 2.0), ("v", "k", 4.0), ("v", "k", 6.0), ("w", "k", 9.0), (None, "k", 5.0)],
                               "f string, g string, y double")
    got = {r["factor"]: r for r in stats.anova(df, ["f", "g"], "y").collect()}
    assert got["f"]["f"] == pytest.approx((38.7 / 2) / (2.5 / 2)) and got["f"]["p_value"] == pytest.approx(N.f_tail(got["f"]["f"], 2, 2))
    assert got["g"]["f"] is None and got["g"]["p_value"] is None


def test_normality_and_moments(spark):
    rng = np.random.default_rng(1)
    df = spark.createDataFrame([(float(a), float(b), 1.0) for a, b in zip(rng.normal(size=500), rng.exponential(size=500))],
                               "n double, e double, c double")
    assert [r["column"] for r in stats.normality(df, ["n", "e", "c"]).collect()] == ["e"]
    w = {k: stats.shapiro_francia(df, k).first()["w"] for k in ("n", "e")}
    assert w["n"] > 0.99 > 0.9 > w["e"]
    assert stats.shapiro_francia(df, "n", span_rows=60).first()["w"] == pytest.approx(w["n"])


def test_term_freq(spark):
    df = spark.createDataFrame([("The Cat, the cat! and 2 dogs-dogs.",), ("CAT",)], "t string")
    assert rows(stats.term_freq(df, "t")) == [("cat", 3), ("dogsdogs", 1)]


def test_decompose_recovers_season(spark):
    df = spark.createDataFrame([("a", i, 0.5 * i + [0, 3, -3, 0][i % 4]) for i in range(40)], "s string, i int, v double")
    out = stats.decompose(df, ["s"], ["i"], "v", 4)
    assert out.filter("trend IS NULL").count() == 4
    assert out.agg(F.max(F.abs("remainder"))).first()[0] < 1e-9
    odd = stats.decompose(df, ["s"], ["i"], "v", 5, span_rows=9)
    assert odd.filter("trend IS NULL").count() == 4


def test_knn_join_of_many_columns_sends_blocks_in_turns(spark, monkeypatch):
    """Where bounds rule out no cell, a query is sent once for each large block, and queries take turns; no neighbour changes."""
    pts = [(i, x) for i, x, _ in _points(400, 24, 5)]
    df = spark.createDataFrame(pts, "k bigint, x array<double>")
    monkeypatch.setattr(neighbors, "FEW_COPIES", 100)
    monkeypatch.setattr(neighbors, "MOST_COPIES", 2)
    turns, real = [], neighbors.Scratch.keep_turns
    monkeypatch.setattr(neighbors.Scratch, "keep_turns", lambda self, make, n: turns.append(n) or real(self, make, n))
    got = knn_join(df, df.withColumnRenamed("k", "n"), "k", "n", "x", 4, exclude_same=True, cell_rows=10, block_rows=40)
    found = {(r["k"], r["rank"]): (r["n"], round(r["distance"], 9)) for r in got.collect()}
    assert turns[0] > 1 and len(found) == got.count() == 4 * 400
    for k, x in pts:
        near = sorted((round(float(np.linalg.norm(np.array(x) - np.array(y))), 9), j) for j, y in pts if j != k)[:4]
        assert [found[k, i] for i in (1, 2, 3, 4)] == [(j, d) for d, j in near]


def test_k_nearest_of_a_block_is_exact():
    """Distances are those that are summed column by column, also next to large values, holes and ties."""
    rng = np.random.default_rng(3)
    bx = np.concatenate([rng.normal(size=(60, 8)), rng.normal(size=(20, 8)) * 1e-7 + 1e6, np.ones((5, 8)), np.full((1, 8), np.inf)])
    for top in (bx, np.concatenate([bx[:-1], np.full((2, 8), 1e200)])):
        x = np.concatenate([top[::3], [[np.nan, *[0.5] * 7]]])
        skip = rng.random((len(x), len(top))) < 0.1
        with np.errstate(invalid="ignore"):
            d = neighbors._distances(x, top)
        d[skip | ~np.isfinite(d)] = np.inf
        for bound in (np.full(len(x), np.inf), np.partition(d, 4, axis=1)[:, 4]):
            row, spot, got = neighbors._k_nearest(x, top, 5, skip, bound)
            want = [(i, j, d[i, j]) for i in range(len(x)) for j in np.argsort(d[i], kind="stable")[:5] if np.isfinite(d[i, j])]
            assert list(zip(row, spot, got)) == want


def test_isomap_landmarks_take_turns(spark, monkeypatch):
    df = spark.createDataFrame([(i, [float(i), float(i * i % 7)]) for i in range(40)], "id long, x array<double>")
    place = lambda: sorted(tuple(round(v, 6) for v in r) for r in encode.landmark_isomap(df, "id", "x", 2, 4, 6).collect())
    whole = place()
    monkeypatch.setattr(encode, "PATH_ROWS", 400)
    turns, real = [], encode.Scratch.keep_turns
    monkeypatch.setattr(encode.Scratch, "keep_turns", lambda self, make, n: turns.append(n) or real(self, make, n))
    assert place() == whole and max(turns) > 1
