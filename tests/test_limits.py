"""Results stay whole: no caps on rounds, outliers, levels, grid rows or series."""

import math

import pytest
from pyspark.ml.linalg import Vectors

from tabkit.operators import encode, impute, models, reshape, stats
from tabkit.plans import QUERIES


def test_isomap_walks_the_whole_arc(spark):
    points = [(i, [math.cos(i * math.pi / 59), math.sin(i * math.pi / 59)]) for i in range(60)]
    got = encode.landmark_isomap(spark.createDataFrame(points, "id long, x array<double>"), "id", "x", 1, n_neighbors=2, n_landmarks=6).collect()
    values = [r["iso_1"] for r in got]
    assert len(got) == 60 and max(values) - min(values) > 3.0          # the arc's length is about pi


def test_all_outliers_are_found(spark):
    rows = [(float(i), 2.0 * i + (i % 7) * 0.01 + (50.0 if i % 40 == 0 else 0.0)) for i in range(800)]
    df = spark.createDataFrame(rows, "x double, y double")
    got = stats.outlier_test(stats.ols(df, "y", ["x"]), df).collect()
    assert {r["x"] for r in got} == {float(i) for i in range(0, 800, 40)}


def test_grid_keeps_empty_rows(spark):
    got = QUERIES["a11_grid_scan"](spark, "/root/testdata/sf0.001").collect()
    assert len(got) == 6


def test_constant_series_keeps_its_rows(spark):
    rows = [("flat", i, 1.0) for i in range(6)] + [("wave", i, float(i % 2)) for i in range(6)]
    got = stats.acf(spark.createDataFrame(rows, "k string, t long, v double"), ["k"], ["t"], "v", 2).collect()
    assert sorted((r["k"], r["lag"]) for r in got) == [(k, lag) for k in ("flat", "wave") for lag in range(3)]
    assert all(r["acf"] is None for r in got if r["k"] == "flat")


def test_lone_class_is_told(spark):
    rows = [(i, "many", [float(i), 0.0]) for i in range(5)] + [(9, "one", [1.0, 1.0])]
    with pytest.raises(ValueError, match="one row"):
        encode.smote(spark.createDataFrame(rows, "id long, y string, x array<double>"), "y", "id", "x").count()


def test_row_without_any_value_gets_the_mean(spark):
    rows = [(i, float(i), 10.0 * i) for i in range(1, 6)] + [(8, None, None), (9, 2.0, None)]
    got = {r["id"]: (r["a"], r["b"]) for r in impute.knn_impute(spark.createDataFrame(rows, "id long, a double, b double"), "id", ["a", "b"], 2).collect()}
    assert got[8] == (3.0, 30.0) and got[9][1] is not None


def test_names_must_fit(spark):
    class Tree:
        featureImportances = Vectors.dense([0.5, 0.5])

    class Model:
        stages = [Tree()]

    with pytest.raises(ValueError, match="1 names for 2"):
        models.importances(Model(), ["a"], spark)


def test_any_number_of_levels(spark):
    df = spark.range(12_000).selectExpr("id", "concat('l', id) AS level_name").unionAll(spark.createDataFrame([(1, "l1"), (2, None)], "id long, level_name string"))
    assert reshape.level_rows(df, "id", "level_name").count() == 12_000
