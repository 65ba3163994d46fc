"""Mixing sources by a curriculum of weights that change over training, with built-in functions only.

Each source has a schedule: knots of (time, weight) over the training run from 0 to 1, linear in
between. The mean weight of a schedule, its integral over the run, is the source's share of the
words that the mix takes; no source gives more than ``most`` passes, and what it can't give goes to
the others by weight. A source's demand up to a time is its target times the part of the integral
reached by then. Its documents stand in the order of a hash, pass after pass, and a document's place
is the time at which the source's demand reaches the words before it: the demand curve is inverted,
a quadratic in each stretch between two knots. Sorting by place gives the order of training.

Words before a document are sums of buckets of the hash plus a running sum within its bucket.
Buckets are as many as the largest source needs to have ``span_rows`` documents in each, so no source
lands in one task.
"""

from __future__ import annotations

from math import ceil, log2

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabkit.sources.workspace import new_path

KEY_BITS = 60
WORD = r"[^\x20\x09-\x0D]+"
SOURCE = ["s", "s_null"]


def knots(*points: tuple[float, float]) -> Column:
    """A schedule through (time, weight) points in rising time."""
    return F.array(*[F.struct(F.lit(float(t)).alias("at"), F.lit(float(w)).alias("weight")) for t, w in points])


def rotating(*shapes):
    """Schedules, each a list of points, given in turn to the sources by their place in code-point order."""
    def of(nth: Column) -> Column:
        out = knots(*shapes[-1])
        for i, shape in enumerate(shapes[:-1]):
            out = F.when(nth % len(shapes) == i, knots(*shape)).otherwise(out)
        return out
    return of


def _segments(line: Column) -> Column:
    """Stretches between knots: start, width, both weights, and the integral before and within."""
    steps = F.transform(F.sequence(F.lit(1), F.size(line) - 1), lambda i: F.struct(
        F.get(line, i - 1)["at"].alias("at"), (F.get(line, i)["at"] - F.get(line, i - 1)["at"]).alias("width"),
        F.get(line, i - 1)["weight"].alias("w0"), F.get(line, i)["weight"].alias("w1")))
    area = lambda s: (s["w0"] + s["w1"]) / 2 * s["width"]                                     # noqa: E731
    return F.transform(steps, lambda s, i: F.struct(
        s["at"].alias("at"), s["width"].alias("width"), s["w0"].alias("w0"), s["w1"].alias("w1"), area(s).alias("area"),
        F.aggregate(F.slice(steps, 1, i), F.lit(0.0), lambda acc, x: acc + area(x)).alias("before")))


def _reached(segments: Column, amount: Column) -> Column:
    """The time at which the integral of the schedule reaches ``amount``."""
    begun = F.filter(segments, lambda s: s["before"] <= amount)
    def within(s):
        x = amount - s["before"]
        root = F.sqrt(F.greatest(F.lit(0.0), s["w0"] * s["w0"] + 2 * ((s["w1"] - s["w0"]) / s["width"]) * x))
        return s["at"] + F.least(s["width"], F.coalesce(F.try_divide(2 * x, s["w0"] + root), F.lit(0.0)))
    return within(F.element_at(begun, -1))


def source_targets(sized: DataFrame, schedule, budget: float, most: int) -> DataFrame:
    """One row per source with its size, segments of its schedule and target.

    Targets are the lesser of ``most`` sizes and a common level times the mean weight, at the level at
    which they add up to the budget; that is where resharing the excess ends. The rows handled here, in
    one task, are one for each source.
    """
    everywhere = Window.partitionBy()
    sources = sized.groupBy(*SOURCE).agg(F.sum("size").alias("source_size"))
    sources = sources.withColumn("nth", F.row_number().over(Window.orderBy("s_null", "s")) - 1)
    sources = sources.withColumn("segments", _segments(schedule(F.col("nth"))))
    sources = sources.withColumns({
        "weight": F.aggregate("segments", F.lit(0.0), lambda acc, s: acc + s["area"]) / F.aggregate(
            "segments", F.lit(0.0), lambda acc, s: acc + s["width"]),
        "cap": (F.col("source_size") * most).cast("double")})
    sources = sources.withColumns({
        "ratio": F.when(F.col("weight") > 0, F.col("cap") / F.col("weight")),
        "words": F.sum("source_size").over(everywhere) * F.lit(float(budget)),
        "weights": F.sum("weight").over(everywhere)})
    upto = Window.orderBy("ratio")
    sources = sources.withColumns({"full": F.sum(F.when(F.col("weight") > 0, F.col("cap"))).over(upto),
                                   "others": F.col("weights") - F.sum("weight").over(upto)})
    fits = F.col("full") + F.col("ratio") * F.col("others") <= F.col("words")
    level = sources.withColumns({
        "full": F.coalesce(F.max(F.when(fits, F.col("full"))).over(everywhere), F.lit(0.0)),
        "others": F.coalesce(F.min(F.when(fits, F.col("others"))).over(everywhere), F.col("weights"))})
    shared = F.when(F.col("others") > 0, F.least("cap", F.col("weight") * (F.col("words") - F.col("full")) / F.col("others")))
    return level.select(*SOURCE, "source_size", "segments", F.when(F.col("weight") > 0, F.coalesce(shared, "cap")).otherwise(
        F.lit(0.0)).alias("target"))


def mixed(docs: DataFrame, schedule, budget: float = 1.5, most: int = 2, seed: int = 11, span_rows: int = 512) -> DataFrame:
    """What the mix takes of each row of ``docs`` (doc_id, text, source), and when.

    Returns doc_id, size (words), source_size, target, taken, and ``placements``: for each pass that takes
    words of the document its number, the words taken from the document's start, and the place between 0
    and 1. ``schedule`` gives the knots of a source by its place in code-point order, null last, which is
    a source of its own. A source's words taken are its target, rounded; the document at the end of the
    demand is taken as far as the demand goes.

    Null and empty texts have no words and no placements. Texts of any length are counted whole. Rows
    with equal or null doc_id are documents of their own; the order within a source is a hash of seed,
    doc_id and text, so reruns agree, and rows that tie in it are alike in all three. An empty table gives
    no rows; other columns of ``docs`` are not looked at.
    """
    path = new_path(docs.sparkSession, "sizes")
    stamp = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"),
                           F.coalesce("text", F.lit(""))).cast("binary"))
    docs.select(
        "doc_id", F.coalesce("source", F.lit("")).alias("s"), F.col("source").isNull().alias("s_null"),
        F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.conv(F.substring(stamp, 1, KEY_BITS // 4), 16, 10).cast("long").alias("key")).write.parquet(path)
    sized = docs.sparkSession.read.parquet(path)
    largest = sized.groupBy(*SOURCE).count().agg(F.max("count")).first()[0] or 1
    bits = max(0, ceil(log2(largest / span_rows)))
    sized = sized.withColumn("bucket", F.shiftright("key", KEY_BITS - bits))

    sources = source_targets(sized, schedule, budget, most)
    before = Window.partitionBy(*SOURCE).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    buckets = sized.groupBy(*SOURCE, "bucket").agg(F.sum("size").alias("bucket_size"))
    buckets = buckets.withColumn("skipped", F.coalesce(F.sum("bucket_size").over(before), F.lit(0))).join(sources, SOURCE)
    inside = Window.partitionBy(*SOURCE, "bucket").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    rows = sized.join(buckets, [*SOURCE, "bucket"]).withColumns({
        "first": F.col("skipped") + F.sum("size").over(inside) - F.col("size"), "total": F.round("target").cast("long")})

    whole = F.aggregate("segments", F.lit(0.0), lambda acc, s: acc + s["area"])
    passes = []
    for n in range(most):
        start = F.col("source_size") * n + F.col("first")
        words = F.greatest(F.lit(0), F.least(F.col("size"), F.col("total") - start))
        place = _reached(F.col("segments"), start / F.col("total") * whole)
        passes.append(F.when(words > 0, F.struct(F.lit(n).alias("pass"), words.alias("words"), place.alias("place"))))
    out = rows.withColumn("placements", F.array_compact(F.array(*passes)))
    taken = F.aggregate("placements", F.lit(0).cast("long"), lambda acc, p: acc + p["words"])
    return out.select("doc_id", "size", "source_size", "target", taken.alias("taken"), "placements")


def training_order(mix: DataFrame) -> DataFrame:
    """One row per document and pass, range-sorted by place: the order in which training reads them."""
    return (mix.select("doc_id", F.explode("placements").alias("p")).select("doc_id", "p.*")
            .orderBy("place", "doc_id", "pass"))


#: Weights 5, 2 and 1 on average: heavy sources early, middling ones half-way, light ones late.
FALLING, MIDDLE, RISING = ((0, 7.5), (1, 2.5)), ((0, 1), (0.5, 3), (1, 1)), ((0, 0.5), (1, 1.5))

MIXED_SQL = r"""
WITH sized AS (
    SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
        CAST('0x' || substr(md5('11:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(text, '')), 1, 15) AS BIGINT) AS k
    FROM documents),
totals AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
ranked AS (SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS kind FROM totals),
weighed AS (SELECT *, CASE kind WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight,
        CAST(2 * source_size AS DOUBLE) AS cap FROM ranked),
words AS (SELECT CAST(sum(source_size) AS DOUBLE) * 1.5::DOUBLE AS words FROM totals),
levels AS (
    SELECT a.cap / a.weight AS ratio, sum(CASE WHEN b.cap / b.weight <= a.cap / a.weight THEN b.cap ELSE 0 END) AS full_words,
        sum(CASE WHEN b.cap / b.weight > a.cap / a.weight THEN b.weight ELSE 0 END) AS others
    FROM weighed a, weighed b GROUP BY a.source, a.cap, a.weight),
level AS (
    SELECT coalesce(max(full_words), 0) AS full_words, coalesce(min(others), (SELECT sum(weight) FROM weighed)) AS others
    FROM levels WHERE full_words + ratio * others <= (SELECT words FROM words)),
sources AS (
    SELECT source, source_size, kind, weight,
        CASE WHEN others > 0 THEN least(cap, weight * (words - full_words) / others) ELSE cap END AS target
    FROM weighed, level, words),
placed AS (
    SELECT z.doc_id, z.size, t.source_size, t.kind, t.weight, t.target, CAST(round(t.target) AS BIGINT) AS total,
        CAST(sum(z.size) OVER (PARTITION BY z.source ORDER BY z.k, z.doc_id, z.size ROWS UNBOUNDED PRECEDING) AS BIGINT) - z.size AS first
    FROM sized z JOIN sources t ON z.source IS NOT DISTINCT FROM t.source),
demand AS (
    SELECT *, greatest(0, least(size, total - first)) + greatest(0, least(size, total - source_size - first)) AS taken,
        CASE WHEN total > first AND size > 0 THEN CAST(first AS DOUBLE) / CAST(total AS DOUBLE) * weight END AS y
    FROM placed),
stretch AS (
    SELECT *, CASE kind WHEN 0 THEN 7.5 WHEN 1 THEN CASE WHEN y < 1 THEN 1 ELSE 3 END ELSE 0.5 END::DOUBLE AS w0,
        CASE kind WHEN 0 THEN -5 WHEN 1 THEN CASE WHEN y < 1 THEN 4 ELSE -4 END ELSE 1 END::DOUBLE AS slope,
        CASE WHEN kind = 1 AND y >= 1 THEN 0.5 ELSE 0 END::DOUBLE AS begun,
        CASE WHEN kind = 1 THEN 0.5 ELSE 1 END::DOUBLE AS width, CASE WHEN kind = 1 AND y >= 1 THEN y - 1 ELSE y END AS x
    FROM demand)
SELECT doc_id, size, source_size, target, CAST(taken AS BIGINT) AS taken,
    CASE WHEN y IS NOT NULL THEN begun + least(width, 2 * x / (w0 + sqrt(greatest(0::DOUBLE, w0 * w0 + 2 * slope * x)))) END AS place
FROM stretch
"""
