"""Scalar expressions used across the operators. All are built-in Spark expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_even(c: Column, digits: int = 0) -> Column:
    """Round half to even, the rule of numeric scripting languages."""
    return F.bround(c, digits)


def floor_bucket(c: Column, width) -> Column:
    """Lower edge of the width-wide bucket that holds the value."""
    return F.floor(c / F.lit(width)) * F.lit(width)


def clip_low(c: Column, low=0.0) -> Column:
    """Raise values below ``low``, and NULL, to ``low``."""
    return F.greatest(F.lit(low), F.coalesce(c, F.lit(low)))


def safe_divide(a: Column, b: Column) -> Column:
    """a / b, NULL where b is zero."""
    return a / F.nullif(b, F.lit(0))


def nan_to_null(c: Column) -> Column:
    return F.when(~F.isnan(c), c)


def harmonics(c: Column, period: float, n: int) -> dict[str, Column]:
    """sin and cos of the first n harmonics of a position within a period."""
    out = {}
    for i in range(1, n + 1):
        angle = F.lit(2.0 * i) * F.pi() * c / F.lit(float(period))
        out[f"sin_{i}"] = F.sin(angle)
        out[f"cos_{i}"] = F.cos(angle)
    return out


def lower_trim(c: Column) -> Column:
    return F.lower(F.trim(c))


def strip_punctuation(c: Column) -> Column:
    return F.regexp_replace(c, r"[!-/:-@\[-`{-~]", "")


def strip_digits(c: Column) -> Column:
    return F.regexp_replace(c, "[0-9]+", "")


def split_trim(c: Column, sep: str = ",") -> Column:
    """Split on a literal separator and trim every element."""
    return F.transform(F.split(c, "\\Q" + sep + "\\E"), lambda x: F.trim(x))


def join_text(*cols: Column, sep: str = ", ") -> Column:
    return F.concat_ws(sep, *cols)


def contains_any(c: Column, words: list[str]) -> Column:
    """True where the text contains one of the words (literal match)."""
    return reduce(lambda a, b: a | b, [c.contains(w) for w in words], F.lit(False))


def digits_of(c: Column) -> Column:
    """First run of digits as a number; NULL if there is none."""
    return F.regexp_extract(c, r"(\d+)", 1).try_cast("bigint")


def weekday_name(d: Column) -> Column:
    return F.date_format(d, "EEEE")


def is_weekend(d: Column) -> Column:
    """Saturday or Sunday; weekday counts from Monday = 0."""
    return F.weekday(d) >= 5


def month_name(d: Column) -> Column:
    return F.date_format(d, "MMMM")


def year_month(d: Column) -> Column:
    return F.date_format(d, "yyyy-MM")


def days_between(end: Column, start: Column) -> Column:
    return F.datediff(end, start)


def recode(c: Column, mapping: dict) -> Column:
    """Replace listed values, keep the rest."""
    out = c
    for old, new in reversed(list(mapping.items())):
        out = F.when(c == F.lit(old), F.lit(new)).otherwise(out)
    return out


def hash_text(*key: Column, seed: int = 0) -> Column:
    """Reproducible pseudo-random text per key; sorting by it is a random order."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[k.cast("string") for k in key]))


def hash_unit(*key: Column, seed: int = 0) -> Column:
    """Reproducible pseudo-random number in [0, 1) per key."""
    return F.conv(F.substring(hash_text(*key, seed=seed), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def hash_bucket(*key: Column, buckets: int, seed: int = 0) -> Column:
    """Reproducible bucket number 0..buckets-1 per key."""
    return F.floor(hash_unit(*key, seed=seed) * buckets).cast("int")
