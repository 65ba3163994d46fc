"""Row order on any amount of data: positions, neighbours and fills that survive a hot key.

A window over one key sorts all rows of that key in one task. That is the right plan
while the largest key is small, and it is checked here by one count. Beyond
``span_rows`` the rows are range-partitioned by (keys, order), written once, and numbered
from per-partition counts; neighbour expressions then run per block of ``span_rows``
positions, with the few rows a block needs from its neighbours copied over.
"""

from __future__ import annotations

from functools import reduce
from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tabkit.sources.workspace import checkpointed

SPAN_ROWS = 2_000_000


def as_columns(cols) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in cols]


def largest_group(df: DataFrame, keys) -> int:
    """Rows of the largest key, or of the whole frame without keys."""
    if not keys:
        return df.count()
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    return sizes.agg(F.max("_n")).first()[0] or 0


def needs_split(df: DataFrame, keys, span_rows: int = SPAN_ROWS) -> bool:
    """True when some key has too many rows for one task. One counting job."""
    return largest_group(df, list(keys)) > span_rows


def null_safe_join(df: DataFrame, other: DataFrame, keys, how: str = "left") -> DataFrame:
    """Equi-join in which NULL keys meet; the other side's keys are dropped."""
    if not keys:
        row = other.select(F.struct("*").alias("_s")).scalar()
        return df.withColumns({c: row[c] for c in other.columns})
    side = other.withColumnsRenamed({k: f"_on_{k}" for k in keys})
    cond = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_on_{k}")) for k in keys])
    out = df.join(side, cond, how)
    return out if how in ("left_semi", "left_anti") else out.drop(*[f"_on_{k}" for k in keys])


def _ranged(df: DataFrame, keys, order, parts: int) -> DataFrame:
    """Range-partition and sort by (keys, order); keep partition number and row number in it."""
    cols = as_columns(keys) + list(order)
    out = df.repartitionByRange(parts, *cols).sortWithinPartitions(*cols)
    out = out.withColumns({
        "_part": F.spark_partition_id(),
        "_row": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)),
    })
    return checkpointed(out)


def with_position(df: DataFrame, order, keys=(), name: str = "position", span_rows: int = SPAN_ROWS,
                  split: bool | None = None) -> DataFrame:
    """Add the 1-based position of each row within its key, in the given order.

    ``order`` must tell the rows of a key apart, or equal rows share an arbitrary order.
    ``split`` is the answer of ``needs_split`` where the caller has it already.
    """
    keys, order = list(keys), as_columns(order)
    if not (needs_split(df, keys, span_rows) if split is None else split):
        return df.withColumn(name, F.row_number().over(W.partitionBy(*keys).orderBy(*order)).cast("bigint"))
    return _position_by_range(df, order, keys, name, max(1, ceil(df.count() / span_rows)))


def _position_by_range(df, order, keys, name, parts) -> DataFrame:
    ranged = _ranged(df, keys, order, parts)
    sizes = ranged.groupBy(*keys, "_part").agg(F.count(F.lit(1)).alias("_n"), F.min("_row").alias("_first"))
    before = W.partitionBy(*keys).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    starts = sizes.select(*keys, "_part", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_skip"))
    out = null_safe_join(ranged, starts, [*keys, "_part"])
    return out.withColumn(name, F.col("_skip") + F.col("_row") - F.col("_first") + 1).drop(
        "_part", "_row", "_first", "_skip")


def over_rows(df: DataFrame, keys, order, build, before: int = 0, after: int = 0,
              span_rows: int = SPAN_ROWS, split: bool | None = None) -> DataFrame:
    """Add window columns that look at most ``before`` rows back and ``after`` rows ahead.

    ``build(window)`` returns name to Column for an ordered window specification.
    """
    keys, order = list(keys), as_columns(order)
    if not (needs_split(df, keys, span_rows) if split is None else split):
        return df.withColumns(build(W.partitionBy(*keys).orderBy(*order)))
    block_rows = max(span_rows, before + after + 1)
    placed = with_position(df, order, keys, "_pos", span_rows, True)
    block = F.floor((F.col("_pos") - 1) / block_rows).cast("bigint")
    inside = (F.col("_pos") - 1) % block_rows
    copies = F.array(
        F.struct(block.alias("block"), F.lit(True).alias("own")),
        F.when(inside >= block_rows - before, F.struct((block + 1).alias("block"), F.lit(False).alias("own"))),
        F.when(inside < after, F.struct((block - 1).alias("block"), F.lit(False).alias("own"))),
    )
    spread = placed.withColumn("_copy", F.explode(F.array_compact(copies))).withColumns(
        {"_block": F.col("_copy.block"), "_own": F.col("_copy.own")})
    done = spread.withColumns(build(W.partitionBy(*keys, "_block").orderBy("_pos")))
    return done.filter("_own").drop("_copy", "_block", "_own", "_pos")


def fill(df: DataFrame, keys, order, cols, how: str = "forward", span_rows: int = SPAN_ROWS,
         split: bool | None = None) -> DataFrame:
    """Replace NULL by the last value before ('forward'), the next after ('backward'),
    or first one and then the other ('downup', 'updown')."""
    cols = [cols] if isinstance(cols, str) else list(cols)
    steps = {"forward": ["f"], "backward": ["b"], "downup": ["f", "b"], "updown": ["b", "f"]}[how]
    keys, order = list(keys), as_columns(order)
    if not (needs_split(df, keys, span_rows) if split is None else split):
        # A frame that ends at the last row is summed anew for every row, so the backward
        # step runs down the positions with a frame that only grows.
        placed = df.withColumn("_pos", F.row_number().over(W.partitionBy(*keys).orderBy(*order)))
        sides = {"f": W.partitionBy(*keys).orderBy("_pos"), "b": W.partitionBy(*keys).orderBy(F.desc("_pos"))}
        return placed.withColumns({c: F.coalesce(*[
            F.last(c, ignorenulls=True).over(sides[s].rowsBetween(W.unboundedPreceding, 0)) for s in steps
        ]) for c in cols}).drop("_pos")
    out = with_position(df, order, keys, "_pos", span_rows, True)
    out = out.withColumn("_block", F.floor((F.col("_pos") - 1) / span_rows).cast("bigint"))
    for step in steps:
        out = _fill_blocks(out, keys, cols, step)
    return out.drop("_pos", "_block")


def _fill_blocks(df, keys, cols, step) -> DataFrame:
    forward = step == "f"
    seen = [F.when(F.col(c).isNotNull(), F.col("_pos")) for c in cols]
    edge = F.max_by if forward else F.min_by
    edges = df.groupBy(*keys, "_block").agg(*[edge(c, s).alias(f"_edge_{c}") for c, s in zip(cols, seen)])
    along = (lambda c: F.col(c)) if forward else F.desc
    wk = W.partitionBy(*keys).orderBy(along("_block")).rowsBetween(W.unboundedPreceding, -1)
    carry = edges.select(*keys, "_block", *[
        F.last(f"_edge_{c}", ignorenulls=True).over(wk).alias(f"_carry_{c}") for c in cols])
    wb = W.partitionBy(*keys, "_block").orderBy(along("_pos")).rowsBetween(W.unboundedPreceding, 0)
    local = df.withColumns({c: F.last(c, ignorenulls=True).over(wb) for c in cols})
    out = null_safe_join(local, carry, [*keys, "_block"])
    return out.withColumns({c: F.coalesce(F.col(c), F.col(f"_carry_{c}")) for c in cols}).drop(
        *[f"_carry_{c}" for c in cols])


def running_totals(df: DataFrame, keys, order: str, cols, span_rows: int = SPAN_ROWS,
                   split: bool | None = None) -> DataFrame:
    """Add ``<col>_cum``, the sum up to and including the row, and ``<col>_total`` per key.

    Rows of a key must differ in the order column (count equal values first).
    """
    keys, cols = list(keys), list(cols)
    if not (needs_split(df, keys, span_rows) if split is None else split):
        w = W.partitionBy(*keys)
        upto = w.orderBy(order).rowsBetween(W.unboundedPreceding, 0)
        return df.withColumns({f"{c}_cum": F.sum(c).over(upto) for c in cols}).withColumns(
            {f"{c}_total": F.sum(c).over(w) for c in cols})
    ranged = _ranged(df, keys, [F.col(order)], max(1, ceil(df.count() / span_rows)))
    sizes = ranged.groupBy(*keys, "_part").agg(*[F.sum(c).alias(f"_s_{c}") for c in cols])
    parts = W.partitionBy(*keys)
    before = parts.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    starts = sizes.select(*keys, "_part", *[e for c in cols for e in (
        F.coalesce(F.sum(f"_s_{c}").over(before), F.lit(0)).alias(f"_skip_{c}"),
        F.sum(f"_s_{c}").over(parts).alias(f"{c}_total"))])
    inside = W.partitionBy(*keys, "_part").orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    run = ranged.withColumns({f"{c}_cum": F.sum(c).over(inside) for c in cols})
    out = null_safe_join(run, starts, [*keys, "_part"])
    return out.withColumns({f"{c}_cum": F.col(f"{c}_cum") + F.col(f"_skip_{c}") for c in cols}).drop(
        "_part", "_row", *[f"_skip_{c}" for c in cols])


def quantiles(df: DataFrame, cols, probs, keys=(), span_rows: int = SPAN_ROWS) -> DataFrame:
    """Exact quantiles with linear interpolation: one row per key, one array per column.

    NULLs are skipped. A key with more than ``span_rows`` rows is not gathered: its
    distinct values are counted, range-partitioned, and only the rows at the wanted
    ranks are read off the running counts.
    """
    keys, cols, probs = list(keys), list(cols), [float(p) for p in probs]
    if not needs_split(df, keys, span_rows):
        return df.groupBy(*keys).agg(*[
            F.percentile(c, F.array(*[F.lit(p) for p in probs])).alias(c) for c in cols])
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("_name"), F.col(c).cast("double").alias("_v")) for c in cols]))
    counts = (df.select(*keys, pairs.alias("_p")).select(*keys, "_p._name", "_p._v").filter("_v IS NOT NULL")
              .groupBy(*keys, "_name", "_v").agg(F.count(F.lit(1)).alias("_n")))
    group = [*keys, "_name"]
    run = running_totals(counts, group, "_v", ["_n"], span_rows, True)
    run = run.withColumnsRenamed({"_n_cum": "_cum", "_n_total": "_total"})
    picks = []
    for p in probs:
        h = (F.col("_total") - 1) * F.lit(p)
        for rank in (F.floor(h), F.ceil(h)):
            picks.append(F.max(F.when((F.col("_cum") - F.col("_n") <= rank) & (rank < F.col("_cum")), F.col("_v"))))
    found = run.groupBy(*group, "_total").agg(*[e.alias(f"_q{i}") for i, e in enumerate(picks)])
    values = []
    for i, p in enumerate(probs):
        h = (F.col("_total") - 1) * F.lit(p)
        lo, hi = F.col(f"_q{2 * i}"), F.col(f"_q{2 * i + 1}")
        values.append(lo + (hi - lo) * (h - F.floor(h)))
    long = found.select(*group, F.array(*values).alias("_qs"))
    wide = [F.max(F.when(F.col("_name") == c, F.col("_qs"))).alias(c) for c in cols]
    got = long.groupBy(*keys).agg(*wide)
    return got if not keys else null_safe_join(df.select(*keys).distinct(), got, keys)


def medians(df: DataFrame, cols, keys=(), span_rows: int = SPAN_ROWS) -> DataFrame:
    """Exact median of each column per key."""
    out = quantiles(df, cols, [0.5], keys, span_rows)
    return out.select(*keys, *[F.get(F.col(c), F.lit(0)).alias(c) for c in cols])
