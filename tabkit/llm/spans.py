"""Places of pattern matches in text, with built-in functions only.

A span is a struct of ``start``, ``end`` (code points, end exclusive) and ``match``. Patterns are
Java's; those here use possessive repeats of groups, so that long matches need no deep stack.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPANS = "array<struct<start: int, end: int, match: string>>"


def settled(value: Column) -> Column:
    """The value, marked as not repeatable, so that no filter or lambda computes it again from its parts."""
    return F.when(F.spark_partition_id() >= 0, value)


def located(text: Column, pattern: str) -> Column:
    """All leftmost matches that don't overlap, in order; an empty array for null.

    The text between matches comes from a split on the same pattern; lengths add up to places.
    """
    between = F.split(text, pattern, -1)
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    steps = F.zip_with(between, found, lambda gap, m: F.struct(F.length(gap).alias("gap"), m.alias("m")))
    nothing = F.expr(f"named_struct('at', 0, 'out', CAST(array() AS {SPANS}))")

    def add(acc, step):
        start = acc["at"] + step["gap"]
        end = start + F.length(step["m"])
        span = F.struct(start.alias("start"), end.alias("end"), step["m"].alias("match"))
        return F.when(step["m"].isNull(), acc).otherwise(F.struct(end.alias("at"), F.concat(acc["out"], F.array(span)).alias("out")))

    spans = F.aggregate(steps, nothing, add, lambda acc: acc["out"])
    return F.when(text.rlike(pattern), spans).otherwise(F.expr(f"CAST(array() AS {SPANS})"))


def tagged(spans: Column, kind: str, rank: int) -> Column:
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"),
                                                 s["end"].alias("end")))


def listing(tagged_spans: Column) -> Column:
    """kind:start:end by start, then kind as ranked, joined by commas."""
    named = F.transform(F.array_sort(tagged_spans), lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"]))
    return F.array_join(named, ",")


def overlapping(spans: Column, start: Column, end: Column) -> Column:
    return F.exists(spans, lambda s: (s["start"] < end) & (s["end"] > start))


def normal_tail(z: Column) -> Column:
    """P(Z > z): a rational approximation of the error function, absolute error below 2e-7."""
    x = F.abs(z) / F.sqrt(F.lit(2.0))
    t = 1 / (1 + 0.3275911 * x)
    # Fixed values of the approximation.
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    upper = 0.5 * poly * F.exp(-x * x)
    return F.when(z >= 0, upper).otherwise(1 - upper)
