"""Written copies and their end."""

import os
import time
from urllib.parse import urlparse

from tabkit.sources.workspace import Scratch, in_turn, release_shuffles


def folder_of(df):
    return os.path.dirname(urlparse(df.inputFiles()[0]).path)


def test_copies_are_freed_one_by_one(spark):
    scratch = Scratch(spark, "copies")
    first = scratch.keep(spark.range(5).selectExpr("id AS a", "CAST(id AS string) AS b"))
    second = scratch.keep(first.filter("a > 2"))
    other = Scratch(spark, "others").keep(spark.range(2).toDF("a"))
    gone, stays, foreign = folder_of(first), folder_of(second), folder_of(other)
    scratch.free(first, other)
    assert not os.path.exists(gone) and os.path.exists(stays) and os.path.exists(foreign)
    assert sorted(r["b"] for r in second.collect()) == ["3", "4"]


def test_empty_frame_keeps_its_schema(spark):
    empty = Scratch(spark, "empty").keep(spark.createDataFrame([], "a long, b array<string>"))
    assert empty.count() == 0 and empty.schema.simpleString() == "struct<a:bigint,b:array<string>>"


def test_shuffle_files_of_a_heavy_frame_go(spark):
    """What a written frame shuffled leaves the disk once its copy stands, without waiting for the driver's own collection."""
    manager = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    held = lambda: sum(os.path.getsize(f) for top, _, names in os.walk(str(manager.localDirs()[0].getPath()))
                       for f in (os.path.join(top, x) for x in names if x.startswith("shuffle_")))
    scratch = Scratch(spark, "heavy")
    for heavy in (False, True):
        before = held()
        kept = scratch.keep(spark.range(400_000).selectExpr("id", "uuid() AS u").repartition(5, "u"), heavy=heavy)
        began = time.time()
        while heavy and held() > before and time.time() < began + 20:
            time.sleep(0.2)
        assert (held() > before + (1 << 20)) != heavy
        assert kept.count() == 400_000


def held(spark):
    manager = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    return sum(os.path.getsize(os.path.join(top, x)) for top, _, names in os.walk(str(manager.localDirs()[0].getPath())) for x in names if x.startswith("shuffle_"))


def settles_below(spark, most):
    began = time.time()
    while held(spark) >= most and time.time() < began + 5:
        time.sleep(0.1)
    return held(spark) < most


def test_the_last_statement_does_not_hold_its_shuffle_files(spark):
    """No statement follows the heavy frame, so nothing else makes Spark's listeners forget its plan."""
    release_shuffles(spark)
    settles_below(spark, 1 << 20)
    before = held(spark)
    kept = Scratch(spark, "last").keep(spark.range(400_000).selectExpr("id", "uuid() AS u").repartition(5, "u"), heavy=True)
    assert settles_below(spark, before + (1 << 20))
    assert kept.count() == 400_000


def test_turns_make_one_copy_and_leave_no_shuffle_files(spark):
    release_shuffles(spark)
    settles_below(spark, 1 << 20)
    rows, before, seen = spark.range(600_000).selectExpr("id", "IF(id % 1000 = 0, NULL, uuid()) AS u"), held(spark), []

    def part(turn):
        settles_below(spark, before + (1 << 20))
        seen.append(held(spark) - before)
        return rows.filter(in_turn("id", turn, 3)).repartition(5, "u")

    scratch = Scratch(spark, "turns")
    kept = scratch.keep_turns(part, 3)
    assert settles_below(spark, before + (1 << 20)) and max(seen) < 1 << 20
    assert kept.count() == kept.select("id").distinct().count() == 600_000 and kept.filter("u IS NULL").count() == 600
    folder = folder_of(kept)
    scratch.free(kept)
    assert not os.path.exists(folder)
