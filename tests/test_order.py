"""Row order, neighbours and quantiles: the split plans must give what one task gives."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabkit.operators import windows
from tabkit.operators.order import (fill, medians, null_safe_join, over_rows, quantiles, running_totals, with_position)
from tabkit.operators.stats import acf
from tests.conftest import rows


@pytest.fixture(scope="module")
def skewed(spark):
    """One key holds most rows; values repeat and have gaps, one key has no value at all."""
    data = [("hot", i, float(i * 7 % 23) if i % 4 else None) for i in range(200)]
    data += [("a", i, None if i < 3 or i > 8 else float(i)) for i in range(12)] + [("b", 0, 5.0)]
    data += [("none", i, None) for i in range(3)] + [(None, i, float(i)) for i in range(4)]
    return spark.createDataFrame(data, "k string, i int, v double").repartition(5).cache()


def test_position_in_blocks_equals_window(skewed):
    one = with_position(skewed, ["i"], ["k"])
    many = with_position(skewed, ["i"], ["k"], span_rows=10)
    assert rows(one, "k", "i", "position") == rows(many, "k", "i", "position")


def test_position_without_keys(skewed):
    order = [F.desc_nulls_last("k"), "i"]
    assert rows(with_position(skewed, order)) == rows(with_position(skewed, order, span_rows=7))


def test_position_of_empty_frame(spark, skewed):
    empty = skewed.filter("1 = 0")
    assert with_position(empty, ["i"], ["k"]).count() == 0
    assert with_position(empty, ["i"], span_rows=3).count() == 0


@pytest.mark.parametrize("span", [1, 5, 50])
def test_neighbours_in_blocks(skewed, span):
    def build(w):
        return {"back": F.lag("v", 9).over(w), "ahead": F.lead("v", 4).over(w), "mean": F.avg("v").over(w.rowsBetween(-9, 4))}
    one = over_rows(skewed, ["k"], ["i"], build, 9, 4)
    many = over_rows(skewed, ["k"], ["i"], build, 9, 4, span_rows=span)
    assert rows(one.withColumn("mean", F.round("mean", 9))) == rows(many.withColumn("mean", F.round("mean", 9)))


@pytest.mark.parametrize("how", ["forward", "backward", "downup", "updown"])
def test_fill_in_blocks(skewed, how):
    one = fill(skewed, ["k"], ["i"], "v", how)
    assert rows(one) == rows(fill(skewed, ["k"], ["i"], ["v"], how, span_rows=3))
    assert one.filter("k = 'none' AND v IS NOT NULL").count() == 0
    if how == "downup":
        assert one.filter("v IS NULL AND k <> 'none'").count() == 0


def test_quantiles_in_blocks(skewed):
    df = skewed.withColumn("w", F.col("v") * F.col("v"))
    probs = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]
    for keys in ([], ["k"]):
        one, many = quantiles(df, ["v", "w"], probs, keys), quantiles(df, ["v", "w"], probs, keys, span_rows=6)
        got = {r[:len(keys)]: r[len(keys):] for r in map(tuple, many.collect())}
        for r in map(tuple, one.collect()):
            for a, b in zip(r[len(keys):], got[r[:len(keys)]]):
                assert (a is None and b is None) or np.allclose(a, b)
    assert len(got) == 5


def test_median_of_even_and_odd_counts(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("b", 3.0), ("b", 1.0), ("b", 10.0), ("c", None)], "k string, v double")
    assert rows(medians(df, ["v"], ["k"])) == [("a", 1.5), ("b", 3.0), ("c", None)]


def test_running_totals_in_blocks(skewed):
    counts = skewed.filter("v IS NOT NULL").groupBy("k", "v").agg(F.count(F.lit(1)).alias("n"))
    one, many = running_totals(counts, ["k"], "v", ["n"]), running_totals(counts, ["k"], "v", ["n"], span_rows=4)
    cols = ["k", "v", "n", "n_cum", "n_total"]
    assert rows(one, *cols) == rows(many, *cols)


def test_null_keys_meet(spark):
    a = spark.createDataFrame([(None, 1), ("x", 2)], "k string, a int")
    b = spark.createDataFrame([(None, 10), ("y", 20)], "k string, b int")
    assert rows(null_safe_join(a, b, ["k"])) == [("x", 2, None), (None, 1, 10)]


def test_window_operators_in_blocks(skewed):
    for make in (
        lambda s: windows.add_lags(skewed, ["k"], ["i"], "v", [1, 14], span_rows=s),
        lambda s: windows.add_leads(skewed, ["k"], ["i"], ["v"], span_rows=s),
        lambda s: windows.rolling_mean(skewed, ["k"], ["i"], "v", 7, span_rows=s).withColumn("v_mean_7", F.round("v_mean_7", 9)),
        lambda s: windows.smooth_local(skewed, ["k"], ["i"], "i", "v", 5, span_rows=s).withColumn("smooth", F.round("smooth", 7)),
        lambda s: acf(skewed.filter("k = 'hot'"), ["k"], ["i"], "v", 5, span_rows=s).withColumn("acf", F.round("acf", 9)),
    ):
        assert rows(make(2_000_000)) == rows(make(11))


def test_drop_superseded_flag(spark):
    df = spark.createDataFrame([("n", "2020-01-01", "Holiday"), ("n", "2020-01-05", "Transfer"), ("n", "2020-03-01", "Holiday"),
                                ("m", "2020-01-01", "Holiday"), ("m", "2020-01-20", "Transfer")],
                               "name string, d string, kind string").withColumn("d", F.to_date("d"))
    kept = windows.drop_superseded(df, ["name"], "d", "kind")
    assert kept.count() == 4
    assert windows.drop_superseded(df, ["name"], "d", "kind", keep_last=False).count() == 3
    assert rows(kept) == rows(windows.drop_superseded(df, ["name"], "d", "kind", span_rows=1))


def test_constant_group_has_no_zscore(spark):
    df = spark.createDataFrame([("a", 2.0), ("a", 2.0), ("b", 1.0), ("c", 1.0), ("c", 3.0)], "k string, v double")
    z = {(r["k"], r["v"]): r["v_z"] for r in windows.zscore(df, ["v"], ["k"]).collect()}
    assert z[("a", 2.0)] is None and z[("b", 1.0)] is None and z[("c", 3.0)] == pytest.approx(2 ** -0.5)
