"""Long and wide forms, indicators and contrasts."""

from __future__ import annotations

from functools import reduce

from pyspark.ml.feature import RFormula
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabkit.functions.scalars import split_trim
from tabkit.operators.columns import clean_name


def separate_rows(df: DataFrame, col: str, sep: str = ",") -> DataFrame:
    """One row per trimmed element of a delimited text."""
    return df.withColumn(col, F.explode(split_trim(F.col(col), sep)))


def levels_of(df: DataFrame, col: str) -> list:
    """Sorted distinct values of a category, as names of columns; ``level_rows`` is the form for many levels."""
    return sorted(r[0] for r in df.select(col).filter(F.col(col).isNotNull()).distinct().collect())


def level_rows(df: DataFrame, key, col: str) -> DataFrame:
    """The indicators of any number of levels as rows: each key with each of its levels once, and 1."""
    keys = [key] if isinstance(key, str) else list(key)
    found = df.filter(F.col(col).isNotNull()).select(*keys, F.col(col).alias("level")).distinct()
    return found.withColumn("value", F.lit(1))


def indicators(df: DataFrame, key, col: str, levels=None, prefix: str = "") -> DataFrame:
    """One row per key with a 0/1 column per level of a multi-valued column."""
    keys = [key] if isinstance(key, str) else list(key)
    levels = levels_of(df, col) if levels is None else levels
    return df.groupBy(*keys).agg(*[
        F.max(F.when(F.col(col) == v, 1).otherwise(0)).alias(prefix + clean_name(str(v), False)) for v in levels])


def one_hot(df: DataFrame, cols, levels: dict | None = None, drop_first: bool = False) -> DataFrame:
    """Replace categories by 0/1 columns ``col_level``.

    Pass the levels found on the training rows to encode other rows alike; a value outside
    them has zeros everywhere.
    """
    levels = levels or {c: levels_of(df, c) for c in cols}
    made = [
        F.when(F.col(c) == v, 1).otherwise(0).alias(f"{c}_{v}")
        for c in cols for v in levels[c][1 if drop_first else 0:]]
    return df.select(*[c for c in df.columns if c not in set(cols)], *made)


def design_matrix(df: DataFrame, formula: str) -> DataFrame:
    """Dummy-coded feature vector from a formula (``features`` and ``label`` columns)."""
    return RFormula(formula=formula, stringIndexerOrderType="alphabetDesc").fit(df).transform(df)


def sum_contrasts(df: DataFrame, col: str, levels=None) -> DataFrame:
    """Deviation coding: column i is 1 on level i, -1 on the last level, else 0."""
    levels = levels_of(df, col) if levels is None else levels
    return df.withColumns({
        f"{col}_{i}": F.when(F.col(col) == v, 1).when(F.col(col) == levels[-1], -1).otherwise(0)
        for i, v in enumerate(levels[:-1], 1)})


def melt(df: DataFrame, ids, values=None, name: str = "variable", value: str = "value") -> DataFrame:
    """Wide to long."""
    values = values or [c for c in df.columns if c not in set(ids)]
    return df.unpivot(list(ids), list(values), name, value)


def interaction_weights(ratings: DataFrame, items: DataFrame, user: str, item: str, rating: str,
                        flags) -> DataFrame:
    """Sum per user and item of 1 + rating + the item's indicator columns."""
    extra = reduce(lambda a, b: a + b, [F.coalesce(F.col(f), F.lit(0)) for f in flags], F.lit(0))
    weighed = ratings.join(items.select(item, extra.alias("_flags")), item, "left")
    return weighed.groupBy(user, item).agg(
        F.sum(F.lit(1.0) + F.col(rating) + F.coalesce(F.col("_flags"), F.lit(0))).alias("weight"))
