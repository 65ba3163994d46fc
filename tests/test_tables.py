"""Readers, columns, rows, joins, summaries and reshaping on tiny frames."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tabkit.functions import scalars as S
from tabkit.operators import agg, columns, joins, reshape, rows as R
from tabkit.sources import calendars, readers, sinks, workspace
from tests.conftest import rows


def test_reader_tokens_and_types(spark):
    path = workspace.new_path(spark, "messy")
    text = spark.createDataFrame(
        [("1", "2.5", "Unknown", "True", "x, \"y\""), (" 2 ", "N/A", "-1", "false", "."), ("NA", "NaN", "", "True", "z")],
        "Id string, `Sale Price` string, Note string, Ok string, Name string")
    sinks.write_table(text, path)
    df = readers.read_table(spark, path, (*readers.NA_TOKENS, "Unknown", "-1"), clean_names=True)
    assert dict(df.dtypes) == {"id": "bigint", "sale_price": "double", "note": "string", "ok": "boolean", "name": "string"}
    assert rows(df) == sorted([(1, 2.5, None, True, 'x, "y"'), (2, None, None, False, None), (None, None, None, True, "z")], key=repr)


def test_read_directory_parses_dates(spark):
    folder = workspace.new_path(spark, "many")
    sinks.write_table(spark.createDataFrame([("2020-01-02", 1), ("bad", 2)], "date string, v int"), folder + "/one.csv")
    sinks.write_table(spark.createDataFrame([("x",)], "k string"), folder + "/two.csv", parts=1)
    got = readers.read_directory(spark, folder)
    assert sorted(got) == ["one", "two"]
    assert {r["v"]: r["date"] for r in got["one"].collect()} == {1: dt.datetime(2020, 1, 2), 2: None}


@pytest.mark.parametrize("name,want", [
    ("SalePrice", "sale_price"), ("2ndFlrSF", "x2nd_flr_sf"), ("MSZoning", "ms_zoning"), ("free sulfur dioxide", "free_sulfur_dioxide"),
    ("Müll %", "mull_percent"), ("pH", "p_h"), ("ID", "id")])
def test_clean_name(name, want):
    assert columns.clean_name(name) == want


def test_clean_names_numbers_repeats(spark):
    df = spark.createDataFrame([(1, 2, 3, 4)], "a int, A int, `a!` int, a_2 int")
    assert columns.clean_names(df).columns == ["a", "a_2", "a_3", "a_2_2"]
    assert columns.clean_name("SalePrice", split_camel=False) == "saleprice"


def test_relocate_conform_and_kinds(spark):
    df = spark.createDataFrame([(1, "x", 2.0)], "a int, b string, c double")
    assert columns.relocate(df, ["c"]).columns == ["c", "a", "b"]
    assert columns.relocate(df, ["a"], after="b").columns == ["b", "a", "c"]
    assert columns.conform(df, ["c", "z"]).first() == (2.0, None)
    assert columns.columns_of(df, "numeric") == ["a", "c"] and columns.columns_of(df, "string") == ["b"]
    assert columns.names_only_in(df, df.drop("a")) == ["a"] and columns.names_in_both(df, df.drop("a")) == ["b", "c"]
    assert columns.xy(df, "c") == (["a", "b"], "c")


def test_convert_truncates_toward_zero(spark):
    df = spark.createDataFrame([("1.9", -1.9), ("x", 2.5)], "a string, b double")
    assert rows(columns.convert_types(df, to_long=["a", "b"])) == [(1, -1), (None, 2)]


def test_rounding_is_half_to_even(spark):
    df = spark.createDataFrame([(0.5,), (1.5,), (2.5,)], "v double")
    assert [r[0] for r in df.select(S.round_even(F.col("v"))).collect()] == [0.0, 2.0, 2.0]
    one = spark.range(1).select(S.round_even(F.lit(250.0), -2), S.clip_low(F.lit(None).cast("double")), S.clip_low(F.lit(-3.0)),
                                S.floor_bucket(F.lit(-1.0), 15), S.safe_divide(F.lit(1.0), F.lit(0.0)),
                                S.recode(F.lit("a"), {"a": "b", "b": "c"})).first()
    assert tuple(one) == (200.0, 0.0, 0.0, -15.0, None, "b")


def test_log_round_trip(spark):
    df = spark.createDataFrame([(0.0,), (1e-9,), (12345.678,)], "v double")
    for r in df.select("v", F.expm1(F.log1p("v")).alias("w")).collect():
        assert r["w"] == pytest.approx(r["v"], rel=1e-12)


def test_splits_cover_all_rows(spark):
    df = spark.range(1000).withColumnRenamed("id", "k")
    train, test = R.train_test_split(df, "k", 0.8, 1)
    assert train.count() + test.count() == 1000 and 740 < train.count() < 860
    assert train.join(test, "k").count() == 0
    folds = R.kfold(df, "k", 10, 1).groupBy("fold").count().collect()
    assert {r["fold"] for r in folds} == set(range(10)) and sum(r["count"] for r in folds) == 1000
    a, b = R.sample_split(df, "k", 60, 5)
    assert a.count() == 60 and b.count() == 940
    yes, no = R.split_by(spark.createDataFrame([(1,), (None,), (-1,)], "v int"), F.col("v") > 0)
    assert (yes.count(), no.count()) == (1, 1)


def test_positions(spark):
    df = spark.range(10).withColumnRenamed("id", "k")
    assert rows(R.slice_rows(df, [F.desc("k")], 20, 40)) == []
    assert rows(R.slice_rows(df, ["k"], 1, 2)) == [(0,), (1,)]
    assert R.drop_positions(df, ["k"], [1, 10]).count() == 8
    assert R.drop_positions(df, ["k"], spark.createDataFrame([(1,), (1,), (2,)], "position int"), span_rows=3).count() == 8


def test_keep_frequent_and_sparse(spark):
    df = spark.createDataFrame([("a", 1), ("a", None), ("b", None), (None, 2), (None, None)], "k string, v int")
    assert rows(R.keep_frequent(df, "k", 2).select("k")) == [("a",), ("a",), (None,), (None,)]
    assert R.drop_sparse_columns(df, 0.5).columns == ["k"]
    assert rows(agg.na_share(df)) == [("k", 2, 0.4), ("v", 3, 0.6)]
    assert rows(agg.cardinality(df)) == [("k", 3), ("v", 3)]


def test_mode_ties(spark):
    df = spark.createDataFrame([(1, "b"), (2, "a"), (3, "a"), (4, "b"), (5, None), (6, None), (7, None)], "i int, v string")
    assert agg.mode_of(df, "v").first()[0] == "a"
    assert agg.mode_of(df, "v", ties="first", order="i").first()[0] == "b"


def test_distinct_on_and_top_k(spark):
    df = spark.createDataFrame([("x", 3, "c"), ("x", 1, "a"), ("y", 2, "b")], "k string, o int, v string")
    assert rows(agg.distinct_on(df, ["k"], ["o"])) == [("x", 1, "a"), ("y", 2, "b")]
    assert rows(agg.top_k(df, [F.desc("o")], 1, ["k"]).select("k", "v")) == [("x", "c"), ("y", "b")]


def test_histogram_edges_close_on_the_right(spark):
    df = spark.createDataFrame([(2.5,), (2.500001,), (7.5,), (-2.5,)], "v double")
    assert rows(agg.histogram(df, "v", width=5)) == [(-5.0, 1), (0.0, 1), (5.0, 2)]
    same = spark.createDataFrame([(4.0,), (4.0,)], "v double")
    assert rows(agg.histogram(same, "v", bins=20)) == [(4.0, 2)]


def test_density_integrates_to_one(spark):
    df = spark.createDataFrame([(float(i % 17),) for i in range(300)], "v double")
    got = sorted((r["x"], r["density"]) for r in agg.density(df, "v", points=200).collect())
    area = sum((b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(got, got[1:]))
    assert 0.8 < area < 1.0
    assert agg.density(spark.createDataFrame([(3.0,)], "v double"), "v", points=3).count() == 3


def test_corr_matrix_is_symmetric_over_complete_rows(spark):
    df = spark.createDataFrame([(1.0, 2.0), (2.0, 4.0), (3.0, 6.5), (9.0, None)], "a double, b double")
    got = {(r["var1"], r["var2"]): r["corr"] for r in agg.corr_matrix(df, ["a", "b"]).collect()}
    assert got[("a", "b")] == got[("b", "a")] and got[("a", "a")] == 1.0 and got[("a", "b")] > 0.99


def test_zero_inflated(spark):
    df = spark.createDataFrame([(0.0, 1.0), (0.0, 2.0), (5.0, 0.0), (None, 3.0)], "a double, b double")
    assert rows(agg.zero_inflated_to_binary(df, ["a", "b"], 0.5)) == [(0.0, 1.0), (0.0, 2.0), (1.0, 0.0), (None, 3.0)]


def test_joins(spark):
    left = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    right = spark.createDataFrame([(1, "x"), (3, "y")], "k int, v string")
    assert rows(joins.join_coalesce(left, right, "k", ["v"])) == [(1, "x"), (2, "b")]
    spine = calendars.calendar(spark, "2020-02-27", "2020-03-01", "d")
    assert spine.count() == 4
    facts = spark.createDataFrame([("a", "2020-02-28", 1), ("b", "2020-03-01", 2)], "k string, d string, v int").withColumn("d", F.to_date("d"))
    grid = joins.align_to_spine(facts, spine, "d", ["k"])
    assert grid.count() == 8 and grid.filter("v IS NOT NULL").count() == 2
    assert joins.align_to_spine(facts.filter("k = 'a'"), spine, "d").count() == 4
    assert rows(joins.join_on_order(left, right, ["k"], [F.desc("k")]).toDF("a", "b", "c", "d")) == [(1, "a", 3, "y"), (2, "b", 1, "x")]


def test_band_join_against_brute_force(spark):
    a = [(i % 3, i, i * 7 % 31) for i in range(60)]
    df = spark.createDataFrame(a, "g int, k int, x int")
    got = rows(joins.band_join(df, df, ["g"], "x", 4).select("k", "k_r"))
    want = sorted(((p[1], q[1]) for p in a for q in a if p[0] == q[0] and abs(p[2] - q[2]) <= 4), key=repr)
    assert got == want


def test_any_match(spark):
    df = spark.createDataFrame([(1, ["a", "b"]), (2, ["b", "c"]), (3, ["d"]), (4, ["a", "b"])], "k int, s array<string>")
    assert joins.any_match(df, df, "s", "s").count() == 5


def test_reshape(spark):
    df = spark.createDataFrame([(1, "a, b"), (2, "b"), (3, None)], "k int, g string")
    long = reshape.separate_rows(df, "g")
    assert rows(long) == [(1, "a"), (1, "b"), (2, "b")]
    assert rows(reshape.indicators(long, "k", "g")) == [(1, 1, 1), (2, 0, 1)]
    hot = reshape.one_hot(spark.createDataFrame([("x",), ("z",)], "c string"), ["c"], {"c": ["x", "y"]})
    assert rows(hot) == [(0, 0), (1, 0)]
    full = reshape.one_hot(spark.createDataFrame([("x",), ("y",)], "c string"), ["c"])
    assert all(sum(r) == 1 for r in rows(full))
    assert reshape.one_hot(spark.createDataFrame([("x",), ("y",)], "c string"), ["c"], drop_first=True).columns == ["c_y"]
    s = spark.createDataFrame([("a",), ("b",), ("c",)], "c string")
    assert rows(reshape.sum_contrasts(s, "c")) == [("a", 1, 0), ("b", 0, 1), ("c", -1, -1)]


def test_level_drift_both_ways(spark):
    a = spark.createDataFrame([("x",), ("y",), (None,)], "c string")
    b = spark.createDataFrame([("y",), ("z",)], "c string")
    assert rows(agg.level_drift(a, b, ["c"])) == [("c", "x", "train"), ("c", "z", "test")]
    assert rows(agg.all_levels(a, b, "c")) == [("x",), ("y",), ("z",)]
    assert rows(agg.entities_except(a, b, "c")) == [("x",), (None,)]


def test_grid_and_calendar(spark):
    grid = calendars.param_grid(a=[1, 2, 3], b=["x", "y"], c=[True])
    assert len(grid) == 6 and grid[1] == {"a": 1, "b": "y", "c": True}
    assert calendars.param_grid_table(spark, a=[1, 2], b=[3]).count() == 2
    assert calendars.calendar(spark, "2013-01-01", "2017-08-31").count() == 1704
    week = calendars.day_type_calendar(calendars.calendar(spark, "2024-01-01", "2024-01-07"))
    assert week.filter("day_type = 'Holiday'").count() == 2


def test_submission(spark):
    df = spark.createDataFrame([(1, 5.0), (2, None), (3, -9.0)], "k int, p double")
    assert rows(sinks.submission(df, "k", "p", "v", "expm1", 0, 0.0)) == [(1, 147.0), (2, 0.0), (3, 0.0)]
    with pytest.raises(ValueError):
        sinks.submission(df, "k", "p", "v", "sqrt")
