"""Column names, order, types and many-column expressions."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def clean_name(name: str, split_camel: bool = True) -> str:
    """snake_case ASCII form of one name; a leading digit gets an ``x``."""
    text = unicodedata.normalize("NFKD", name).encode("ascii", "ignore").decode()
    text = text.replace("%", "_percent_").replace("#", "_number_")
    if split_camel:
        text = re.sub(r"(?<=[a-z])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])|(?<=\d)(?=[A-Z][a-z])", "_", text)
    text = re.sub(r"[^0-9a-zA-Z]+", "_", text).strip("_").lower()
    return f"x{text}" if not text or text[0].isdigit() else text


def clean_names(df: DataFrame, split_camel: bool = True) -> DataFrame:
    """Clean every column name; repeats get a running number."""
    seen: dict[str, int] = {}
    taken: set[str] = set()
    names = []
    for c in df.columns:
        base = clean_name(c, split_camel)
        seen[base] = seen.get(base, 0) + 1
        name = base if seen[base] == 1 else f"{base}_{seen[base]}"
        while name in taken:
            seen[base] += 1
            name = f"{base}_{seen[base]}"
        taken.add(name)
        names.append(name)
    return df.toDF(*names)


def underscore_names(df: DataFrame) -> DataFrame:
    """Spaces in names become underscores, nothing else changes."""
    return df.toDF(*[c.replace(" ", "_") for c in df.columns])


def relocate(df: DataFrame, first, after: str | None = None) -> DataFrame:
    """Move the listed columns to the front, or behind the column ``after``."""
    rest = [c for c in df.columns if c not in set(first)]
    if after is None:
        return df.select(*first, *rest)
    at = rest.index(after) + 1
    return df.select(*rest[:at], *first, *rest[at:])


def conform(df: DataFrame, cols) -> DataFrame:
    """Exactly the given columns in the given order; those missing become NULL."""
    have = set(df.columns)
    return df.select(*[F.col(c) if c in have else F.lit(None).alias(c) for c in cols])


_KINDS = {
    "numeric": T.NumericType,
    "integer": T.IntegralType,
    "double": (T.DoubleType, T.FloatType, T.DecimalType),
    "string": T.StringType,
    "boolean": T.BooleanType,
    "date": (T.DateType, T.TimestampType),
}


def columns_of(df: DataFrame, kind: str, exclude=()) -> list[str]:
    """Names of the columns of one kind of type."""
    return [f.name for f in df.schema.fields if isinstance(f.dataType, _KINDS[kind]) and f.name not in set(exclude)]


def names_only_in(a: DataFrame, b: DataFrame) -> list[str]:
    have = set(b.columns)
    return [c for c in a.columns if c not in have]


def names_in_both(a: DataFrame, b: DataFrame) -> list[str]:
    have = set(b.columns)
    return [c for c in a.columns if c in have]


def across(df: DataFrame, cols, fn) -> DataFrame:
    """Apply one Column function to many columns, in one projection."""
    return df.withColumns({c: fn(F.col(c)) for c in cols})


def rename_by_type(df: DataFrame, target: str | None = None, keep=()) -> DataFrame:
    """Text columns become ``cat-01`` … in name order, integers ``bin-01`` … in column order."""
    fixed = set(keep) | ({target} if target else set())
    names = {c: f"cat-{i:02d}" for i, c in enumerate(sorted(columns_of(df, "string", fixed)), 1)}
    names |= {c: f"bin-{i:02d}" for i, c in enumerate(columns_of(df, "integer", fixed), 1)}
    if target:
        names[target] = "target"
    return df.toDF(*[names.get(c, c) for c in df.columns])


def convert_types(df: DataFrame, to_double=(), to_long=(), to_category=(), to_byte=()) -> DataFrame:
    """Cast columns by group; unreadable values become NULL, integer casts truncate."""
    plan: dict[str, Column] = {c: F.col(c).try_cast("double") for c in to_double}
    for names, kind in ((to_long, "bigint"), (to_byte, "tinyint")):
        for c in names:
            source = F.col(c)
            if isinstance(df.schema[c].dataType, T.StringType):
                source = source.try_cast("double")
            plan[c] = source.try_cast(kind)
    plan |= {c: F.col(c).cast("string") for c in to_category}
    return df.withColumns(plan)


def add_column(df: DataFrame, name: str, expr: Column, after: str | None = None) -> DataFrame:
    """Add a column at the front, or behind the column ``after``."""
    return relocate(df.withColumn(name, expr), [name], after)


def update_where(df: DataFrame, cond: Column, col: str, value) -> DataFrame:
    """Set a column on the rows where the condition holds."""
    value = value if isinstance(value, Column) else F.lit(value)
    return df.withColumn(col, F.when(cond, value).otherwise(F.col(col)))


def tag_id(df: DataFrame, col: str, tag: str) -> DataFrame:
    """Mark keys of one data set with a suffix, so that keys of several sets can share a table."""
    return df.withColumn(col, F.concat(F.col(col).cast("string"), F.lit(f"_{tag}")))


def untag_id(df: DataFrame, col: str) -> DataFrame:
    return df.withColumn(col, F.regexp_extract(col, r"(\d+)", 1).try_cast("bigint"))


def xy(df: DataFrame, target: str, exclude=()) -> tuple[list[str], str]:
    """Feature names and target name."""
    return [c for c in df.columns if c != target and c not in set(exclude)], target
