"""Shared folder for cut lineage and written tables."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, as the session names it in spark.checkpoint.dir.

    Only a local session without the setting gets a folder of its own.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    base = tempfile.mkdtemp(prefix="tabkit-")
    spark.conf.set("spark.checkpoint.dir", base)
    return base


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def checkpointed(df: DataFrame) -> DataFrame:
    """Write the frame to the shared folder and go on from the written copy."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return df.checkpoint(eager=True)


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per session.

    Functions of the package that run on executors are pickled by name; workers that cannot import
    the package from their own path take it from here.
    """
    sc = spark.sparkContext
    if getattr(sc, "_tabkit_shipped", False):
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    target = os.path.join(tempfile.mkdtemp(prefix="tabkit-ship-"), "tabkit.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(root):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.join("tabkit", os.path.relpath(full, root)))
    sc.addPyFile(target)
    sc._tabkit_shipped = True


def release_shuffles(spark: SparkSession) -> None:
    """Have the driver collect its garbage, since shuffle files go with the frames that wrote them.

    Spark's listeners hold the last statement's plan until the next one ends, so an empty one goes first.
    """
    spark.sql("SELECT 1").collect()
    gc.collect()
    spark.sparkContext._jvm.java.lang.System.gc()


def in_turn(key: str | Column, turn: int, turns: int) -> Column:
    """Whether a row's key belongs to this turn of so many; rows without a key are in one of them too."""
    return F.pmod(F.xxhash64(F.lit(11), F.col(key) if isinstance(key, str) else key), F.lit(turns)) == turn


class Scratch:
    """Written copies of one job's frames in the shared folder, freed one by one.

    ``keep`` writes a frame as compressed Parquet and goes on from the written copy, so its lineage
    is cut. ``free`` deletes copies of this object alone. Free a copy only when every frame that
    reads it is itself kept: a lost executor then never needs what is gone. Shuffle files of a written
    frame go when the driver happens to collect its garbage; ``keep`` asks for that if it was ``heavy``.
    ``keep_turns`` writes the parts of a frame one after the other into one copy, so that the disk holds
    the shuffle files of one part at a time.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.name, self._kept = spark, name, []

    def keep(self, df: DataFrame, heavy: bool = False) -> DataFrame:
        path = new_path(self.spark, self.name)
        df.write.option("compression", "zstd").parquet(path)
        if heavy:
            release_shuffles(self.spark)
        copy = self.spark.read.schema(df.schema).parquet(path)
        self._kept.append((copy, path))
        return copy

    def keep_turns(self, make: Callable[[int], DataFrame], turns: int) -> DataFrame:
        """One copy of ``make(0)`` to ``make(turns - 1)``, which must have one schema."""
        parts = [self.keep(make(turn), heavy=True) for turn in range(turns)]
        if turns == 1:
            return parts[0]
        mine, rest = ([x for x in self._kept if any(x[0] is part for part in parts) == own] for own in (True, False))
        whole = self.spark.read.schema(parts[0].schema).parquet(*(path for _, path in mine))
        self._kept = [*rest, *((whole, path) for _, path in mine)]
        return whole

    def free(self, *frames: DataFrame) -> None:
        """Delete the copies; frames that this object does not hold are left alone."""
        rest = []
        for copy, path in self._kept:
            if any(copy is x for x in frames):
                target = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
                target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
            else:
                rest.append((copy, path))
        self._kept = rest
