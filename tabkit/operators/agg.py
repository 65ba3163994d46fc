"""Summaries, frequency tables, histograms, correlations, top-k and set operations."""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tabkit.operators.order import (SPAN_ROWS, as_columns, null_safe_join, quantiles,
                                    with_position)


def one_row_to_long(row: DataFrame, cols, measures: dict[str, str], name: str = "column") -> DataFrame:
    """Turn one row with columns ``<col>|<measure>`` into one row per column."""
    items = [
        F.struct(F.lit(c).alias(name), *[F.col(f"`{c}|{m}`").cast(t).alias(m) for m, t in measures.items()])
        for c in cols
    ]
    return row.select(F.explode(F.array(*items)).alias("_x")).select("_x.*")


def na_share(df: DataFrame) -> DataFrame:
    """NULL count and share per column, from one aggregate."""
    flags = {c: F.col(f"`{c}`").isNull() for c in df.columns}
    row = df.agg(*[F.count_if(e).alias(f"{c}|na_count") for c, e in flags.items()],
                 *[F.avg(e.cast("double")).alias(f"{c}|na_share") for c, e in flags.items()])
    return one_row_to_long(row, df.columns, {"na_count": "bigint", "na_share": "double"})


def na_profile(tables: dict[str, DataFrame]) -> DataFrame:
    """NULL count of every column of every table."""
    return union_all([
        na_share(df).select(F.lit(name).alias("table"), "column", "na_count") for name, df in tables.items()])


def cardinality(df: DataFrame, cols=None) -> DataFrame:
    """Distinct values per column; NULL counts as a value.

    Columns are turned into (column, value) rows and deduplicated in two steps, so that
    one pass serves all columns and no single task holds the values of one of them.
    """
    cols = list(cols or df.columns)
    long = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("string").alias("value")) for c in cols
    ])).alias("_x")).select("_x.*")
    return long.distinct().groupBy("column").agg(F.count(F.lit(1)).alias("n_distinct"))


def binary_columns(df: DataFrame) -> list[str]:
    """Columns with exactly two distinct values."""
    return sorted(r["column"] for r in cardinality(df).filter("n_distinct = 2").collect())


def rate_by(df: DataFrame, keys, flag: str) -> DataFrame:
    """Rows, sum of a 0/1 column, and its rate per group."""
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.sum(flag).cast("bigint").alias("hits"), F.avg(F.col(flag).cast("double")).alias("rate"))


def freq(df: DataFrame, col, pct: bool = False) -> DataFrame:
    """Count per value; with ``pct`` also its share in percent."""
    cols = [col] if isinstance(col, str) else list(col)
    counts = df.groupBy(*cols).agg(F.count(F.lit(1)).alias("n"))
    if not pct:
        return counts
    total = counts.agg(F.sum("n")).scalar()
    return counts.withColumn("pct", F.col("n") * F.lit(100.0) / total)


def crosstab_long(df: DataFrame, keys) -> DataFrame:
    return freq(df, keys)


def crosstab_wide(df: DataFrame, row: str, col: str, levels: list) -> DataFrame:
    """Counts with one column per level; the levels are given, so no extra job finds them."""
    return df.groupBy(row).pivot(col, levels).agg(F.count(F.lit(1))).fillna(0, [str(x) for x in levels])


def histogram(df: DataFrame, col: str, width: float | None = None, bins: int | None = None, by=()) -> DataFrame:
    """Counts per bin centre. Bins are closed on the right.

    With a width, bins are centred on its multiples. With a number of bins, the first is
    centred on the minimum and the last on the maximum over all groups.
    """
    by = [by] if isinstance(by, str) else list(by)
    x = F.col(col).cast("double")
    if width is not None:
        centre = F.ceil((x - width / 2.0) / F.lit(float(width))) * F.lit(float(width))
    else:
        ends = df.agg(F.struct(F.min(x).alias("lo"), F.max(x).alias("hi")).alias("e")).scalar()
        step = (ends["hi"] - ends["lo"]) / F.lit(float(bins - 1))
        slot = F.ceil((x - ends["lo"]) / F.nullif(step, F.lit(0.0)) - 0.5)
        centre = ends["lo"] + F.coalesce(slot, F.lit(0)) * step
    return (df.filter(F.col(col).isNotNull()).withColumn("bin", centre)
            .groupBy(*by, "bin").agg(F.count(F.lit(1)).alias("n")))


def density(df: DataFrame, col: str, by=(), points: int = 64, span_rows: int = SPAN_ROWS) -> DataFrame:
    """Gaussian kernel density per group on an even grid from minimum to maximum.

    Bandwidth is 0.9 min(sd, IQR/1.34) n^-1/5. Equal values are counted first; every grid
    point is one sum of a single aggregate, so no row is multiplied by the grid.
    """
    by = [by] if isinstance(by, str) else list(by)
    data = df.filter(F.col(col).isNotNull()).select(*by, F.col(col).cast("double").alias("_x"))
    basic = data.groupBy(*by).agg(
        F.min("_x").alias("_lo"), F.max("_x").alias("_hi"), F.stddev_samp("_x").alias("_sd"),
        F.count(F.lit(1)).alias("_n"))
    q = quantiles(data, ["_x"], [0.25, 0.75], by, span_rows).withColumnRenamed("_x", "_q")
    iqr = (F.get("_q", F.lit(1)) - F.get("_q", F.lit(0))) / 1.34
    spread = F.coalesce(F.nullif(F.least("_sd", F.when(iqr > 0, iqr).otherwise(F.col("_sd"))), F.lit(0.0)), F.lit(1.0))
    stats = null_safe_join(basic, q, by).select(
        *by, "_lo", "_hi", "_n", (F.lit(0.9) * spread * F.pow("_n", F.lit(-0.2))).alias("_bw"))
    counted = null_safe_join(data.groupBy(*by, "_x").agg(F.count(F.lit(1)).alias("_w")), stats, by)

    def point(j):
        return F.col("_lo") + (F.col("_hi") - F.col("_lo")) * F.lit(j / (points - 1))

    sums = [F.sum(F.col("_w") * F.exp(F.lit(-0.5) * F.pow((F.col("_x") - point(j)) / F.col("_bw"), F.lit(2.0)))).alias(f"_s{j}")
            for j in range(points)]
    wide = counted.groupBy(*by, "_lo", "_hi", "_n", "_bw").agg(*sums)
    items = F.array(*[F.struct(
        F.lit(j).alias("point"), point(j).alias("x"),
        (F.col(f"_s{j}") / (F.col("_n") * F.col("_bw") * F.sqrt(F.lit(2.0) * F.pi()))).alias("density"))
        for j in range(points)])
    return wide.select(*by, F.explode(items).alias("_p")).select(*by, "_p.*")


def describe_num(df: DataFrame, cols, keys=(), span_rows: int = SPAN_ROWS) -> DataFrame:
    """Count, mean, sd, minimum, quartiles and maximum per column, NULLs skipped."""
    keys = list(keys)
    q = quantiles(df, cols, [0.25, 0.5, 0.75], keys, span_rows).withColumnsRenamed({c: f"_q_{c}" for c in cols})
    basic = df.groupBy(*keys).agg(*[e for c in cols for e in (
        F.count(c).alias(f"{c}|n"), F.avg(c).alias(f"{c}|mean"), F.stddev_samp(c).alias(f"{c}|sd"),
        F.min(c).cast("double").alias(f"{c}|min"), F.max(c).cast("double").alias(f"{c}|max"))])
    both = null_safe_join(basic, q, keys)
    items = [F.struct(
        F.lit(c).alias("column"), *[F.col(f"`{c}|{m}`").alias(m) for m in ("n", "mean", "sd", "min")],
        *[F.get(F.col(f"_q_{c}"), F.lit(i)).alias(m) for i, m in enumerate(("q25", "median", "q75"))],
        F.col(f"`{c}|max`").alias("max")) for c in cols]
    return both.select(*keys, F.explode(F.array(*items)).alias("_x")).select(*keys, "_x.*")


def mode_of(df: DataFrame, col: str, keys=(), ties: str = "smallest", order: str | None = None) -> DataFrame:
    """Most frequent value per key, NULLs skipped; ties go to the smallest value, or to the
    one seen first in the given order. Counts first, then one small aggregate."""
    keys = list(keys)
    first = F.min(order) if ties == "first" else F.first(F.lit(0))
    counts = df.filter(F.col(col).isNotNull()).groupBy(*keys, col).agg(
        F.count(F.lit(1)).alias("_n"), first.alias("_first"))
    rank = F.struct(-F.col("_n"), F.col("_first"), F.col(col))
    return counts.groupBy(*keys).agg(F.min_by(col, rank).alias("mode"), F.max("_n").alias("n"))


def distinct_on(df: DataFrame, keys, order) -> DataFrame:
    """One row per key: the first in the given order. Done as a partial aggregate, not a sort.

    The columns of ``order`` sort ascending.
    """
    rest = [c for c in df.columns if c not in set(keys)]
    ranked = df.groupBy(*keys).agg(
        F.min_by(F.struct(*[F.col(f"`{c}`") for c in rest]), F.struct(*as_columns(order))).alias("_row"))
    return ranked.select(*keys, "_row.*").select(*df.columns)


def share_where(df: DataFrame, keys, cond: Column, name: str = "share") -> DataFrame:
    return df.groupBy(*keys).agg(F.avg(cond.cast("double")).alias(name))


def corr_by(df: DataFrame, x: str, y: str, keys=()) -> DataFrame:
    """Pearson correlation per group over rows where both values are present."""
    both = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    return both.groupBy(*keys).agg(F.corr(x, y).alias("corr"))


def corr_matrix(df: DataFrame, cols) -> DataFrame:
    """All pairwise correlations over complete rows, long form, from one aggregate."""
    cols = list(cols)
    full = df.select(*cols).dropna()
    row = full.agg(*[F.corr(a, b).alias(f"{a}|{b}") for a, b in combinations(cols, 2)],
                   *[F.when(F.stddev_pop(c) > 0, 1.0).alias(f"{c}|{c}") for c in cols])
    items = [F.struct(F.lit(a).alias("var1"), F.lit(b).alias("var2"),
                      F.col(f"`{a}|{b}`" if f"{a}|{b}" in row.columns else f"`{b}|{a}`").alias("corr"))
             for a in cols for b in cols]
    return row.select(F.explode(F.array(*items)).alias("_x")).select("_x.*")


def collect_text(df: DataFrame, keys, col: str, order, sep: str = ", ") -> DataFrame:
    """Values of a group as one text, in the given order.

    The text holds the whole group, so give it groups that are small by construction,
    such as a top-k list per user.
    """
    pair = F.struct(*[o.alias(f"o{i}") for i, o in enumerate(as_columns(order))], F.col(col).cast("string").alias("v"))
    return df.groupBy(*keys).agg(
        F.concat_ws(sep, F.transform(F.sort_array(F.collect_list(pair)), lambda x: x["v"])).alias(col))


def mismatch(df: DataFrame, pred: str, actual: str) -> DataFrame:
    """Number and percentage of right and wrong predictions."""
    wrong = (~F.col(pred).eqNullSafe(F.col(actual)))
    return df.agg(
        F.count(F.lit(1)).alias("n"), F.count_if(wrong).alias("errors"),
        (F.avg(wrong.cast("double")) * 100.0).alias("error_pct"),
        (F.avg((~wrong).cast("double")) * 100.0).alias("correct_pct"))


def zero_shares(df: DataFrame, cols) -> DataFrame:
    cols = list(cols)
    row = df.agg(*[F.avg((F.col(c) == 0).cast("double")).alias(f"{c}|zero_share") for c in cols])
    return one_row_to_long(row, cols, {"zero_share": "double"})


def zero_inflated_to_binary(df: DataFrame, cols, threshold: float) -> DataFrame:
    """Columns with at least the given share of zeros become 0/1; NULL stays NULL."""
    picked = [r["column"] for r in zero_shares(df, cols).filter(F.col("zero_share") >= threshold).collect()]
    return df.withColumns({
        c: F.when(F.col(c).isNotNull(), F.when(F.col(c) != 0, 1.0).otherwise(0.0)) for c in picked})


def group_count(df: DataFrame, keys) -> DataFrame:
    """Number of distinct key combinations."""
    return df.select(*keys).distinct().agg(F.count(F.lit(1)).alias("n_groups"))


def head_by(df: DataFrame, order, n: int = 6) -> DataFrame:
    return df.orderBy(*as_columns(order)).limit(n)


def rank_levels(df: DataFrame, col: str, span_rows: int = SPAN_ROWS) -> DataFrame:
    """Levels with their rank by falling count (name breaks ties)."""
    counts = freq(df.filter(F.col(col).isNotNull()), col)
    return with_position(counts, [F.desc("n"), F.asc(col)], name="level_rank", span_rows=span_rows)


def top_k(df: DataFrame, order, k: int, keys=()) -> DataFrame:
    """First k rows in the given order, overall or per key. Both plans cut to k rows in each
    map task before anything is shuffled."""
    if not keys:
        return df.orderBy(*as_columns(order)).limit(k)
    w = W.partitionBy(*keys).orderBy(*as_columns(order))
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def above(df: DataFrame, score: str, threshold: float) -> DataFrame:
    return df.filter(F.col(score) > threshold).orderBy(F.desc(score))


def tag_union(train: DataFrame, test: DataFrame, tag: str = "data_type") -> DataFrame:
    """Both sets in one table with a tag column; columns missing on one side become NULL."""
    return train.withColumn(tag, F.lit("train")).unionByName(
        test.withColumn(tag, F.lit("test")), allowMissingColumns=True)


def union_all(dfs) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), dfs)


def _levels(df: DataFrame, cols) -> DataFrame:
    return df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("level")) for c in cols
    ])).alias("_x")).select("_x.*").filter("level IS NOT NULL").distinct()


def level_drift(train: DataFrame, test: DataFrame, cols) -> DataFrame:
    """Category levels found on one side only, per column."""
    a, b = _levels(train, cols), _levels(test, cols)
    return (a.join(b, ["column", "level"], "left_anti").withColumn("only_in", F.lit("train"))
            .unionByName(b.join(a, ["column", "level"], "left_anti").withColumn("only_in", F.lit("test"))))


def entities_except(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Keys of a that b does not have."""
    return a.select(key).distinct().join(b.select(key).distinct(), key, "left_anti")


def all_levels(a: DataFrame, b: DataFrame, col: str) -> DataFrame:
    """Levels found on either side."""
    return a.select(col).union(b.select(col)).filter(F.col(col).isNotNull()).distinct()


