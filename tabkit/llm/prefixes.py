"""Candidate pairs of similar sets by prefixes of their elements, rarest first."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabkit.sources.workspace import Scratch, in_turn

FEW = 17
SLICES = 4                                                  # large joins go in so many turns, each of a part of the keys
SMALL = 20_000                                              # rows that need no turns


def turns_of(rows: DataFrame) -> int:
    """In how many turns to join written rows: the disk then holds a part of their shuffles at a time."""
    return SLICES if rows.count() > SMALL else 1


def prefix_candidates(sets: DataFrame, percent: int, scratch: Scratch, turns: int = 1) -> tuple[DataFrame, DataFrame]:
    """Pairs (a, b, votes) and groups (group, c, n, left, low, odd) that hold all pairs of ``sets`` that link.

    ``sets`` (name, n, s) has the elements s of each set, repeated rows or not, and the number n of distinct ones. Elements are put in one
    order, rare ones first. Sets that link share one of their first n - ceil(percent * n / 100) + 1
    elements, and at the first that they share, what is left of both is enough for the threshold. Elements
    that stand in many prefixes become groups, cut by bands of set size: a set stands in its own band and,
    as ``low``, in the next, so that sets of neighbouring bands meet once. Groups of the same members are one:
    neighbouring shingles of a passage stand in the same sets, and their pairs need listing once. Members carry
    their parities, so that of a group only pairs are listed that differ in few of them. ``sets`` is read twice, and once more
    by parts of its names if there are several ``turns``, so a filter on them should spare work.
    """
    dealt = sets.repartition("s")                           # in one turn counted and joined from one shuffle, as both read all its columns
    often = (dealt.groupBy("s").agg(F.count("*").alias("times"), F.min("name").alias("p"), F.max("name").alias("q"), F.max("n").alias("most"))
             .filter("p <> q AND most > 0").select("s", "times"))
    often = often if turns == 1 else scratch.keep(often, heavy=True)
    alone = F.col("n") - F.size("x")                        # elements of this set only come first
    first = F.expr(f"n - CAST(({percent} * n + 99) DIV 100 AS int) + 1")
    prefix = F.slice("x", F.lit(1), F.greatest(first - alone, F.lit(0)))

    def begun(turn: int) -> DataFrame:                      # what the sets of this turn's names begin with
        mine = dealt if turns == 1 else sets.filter(in_turn("name", turn, turns))
        common = mine.join(often, "s").groupBy("name").agg(F.first("n").alias("n"), F.sort_array(F.collect_set(F.struct("times", "s"))).alias("x"))
        begins = common.select("name", "n", alone.alias("alone"), F.transform(prefix, lambda x: x["s"]).alias("x"))
        return (begins.select("name", "n", "alone", F.posexplode("x").alias("at", "s"))
                .select("name", "n", (F.col("n") - F.col("alone") - F.col("at")).alias("left"), "s"))

    entries = scratch.keep_turns(begun, turns)
    scratch.free(often)
    sized = entries.join(entries.groupBy("s").agg(F.count("*").alias("size")).filter("size > 1"), "s")
    few = sized.filter(F.col("size") < FEW)
    one, other = (few.select("s", F.col("name").alias(c), F.col("n").alias(f"{c}n"), F.col("left").alias(f"{c}left")) for c in ("a", "b"))
    pairs = scratch.keep(one.join(other, "s").filter(F.expr("a < b") & may_link("an", "bn", "aleft", "bleft", percent))
                         .groupBy("a", "b").agg(F.count("*").alias("votes")), heavy=True)
    band = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(100 / percent)) + 1e-9).cast("int")
    own, below = F.struct(band.alias("band"), F.lit(False).alias("low")), F.struct((band + 1).alias("band"), F.lit(True).alias("low"))
    groups = scratch.keep(sized.filter(F.col("size") >= FEW).select("s", F.col("name").alias("c"), "n", "left", F.explode(F.array(own, below)).alias("x"))
                          .select(F.xxhash64("s", "x.band").alias("group"), "c", "n", "left", "x.low"), heavy=True)
    marks = parities(sets).withColumnRenamed("name", "c")
    merged = scratch.keep(merged_groups(groups).join(marks, "c", "left").select("group", "c", "n", "left", "low", "odd"), heavy=True)
    scratch.free(entries, groups)
    return pairs, merged


def merged_groups(groups: DataFrame) -> DataFrame:
    """One group for all of the same members; each member has the most that any of them leaves, so no pair that one allows is lost.

    Members are compared by their number and two sums of hashes. Groups with a single member, or with
    members of the band below only, list no pairs and are left out.
    """
    member = F.xxhash64("c", "low").cast("decimal(20,0)")
    other = F.xxhash64(F.lit(7), "c", "low").cast("decimal(20,0)")
    marks = (groups.groupBy("group").agg(F.count("*").alias("size"), F.sum(member).alias("p"), F.sum(other).alias("q"), F.min("low").alias("all_low"))
             .filter("size > 1 AND NOT all_low"))
    same = marks.select("group", F.xxhash64("size", "p", "q").alias("whole"))
    return (groups.join(same, "group").groupBy(F.col("whole").alias("group"), "c", "low").agg(F.first("n").alias("n"), F.max("left").alias("left"))
            .select("group", "c", "n", "left", "low"))


def parities(sets: DataFrame) -> DataFrame:
    """name and odd: 64-bit words of bits, each telling whether an odd number of a set's elements falls on it.

    There are two to four bits an element, 64 at least. Two sets differ in at least as many elements as their bits;
    the number of bits is a power of two, so that the halves of twice as many fold into one. Sets with repeated rows
    are left out.
    """
    words = F.expr("CAST(power(2, ceil(log2(greatest(n / 32D, 1D)))) AS int)")
    cell = F.pmod(F.xxhash64(F.lit(3), "s"), (64 * F.col("words")).cast("long"))
    parts = (sets.select("name", "n", "s", words.alias("words")).withColumn("cell", cell).groupBy("name", "n", "words", F.expr("CAST(cell DIV 64 AS int)").alias("at"))
             .agg(F.expr("bit_xor(shiftleft(1L, CAST(cell & 63 AS int)))").alias("bits"), F.count("*").alias("rows")))
    return (parts.groupBy("name", "n", "words").agg(F.sum("rows").alias("rows"), F.map_from_entries(F.collect_list(F.struct("at", "bits"))).alias("held"))
            .filter("rows = n").select("name", F.expr("transform(sequence(0, words - 1), i -> coalesce(element_at(held, i), 0L))").alias("odd")))


def apart(x: str, y: str) -> str:
    """The number of bits in which two columns of parities differ, the longer one folded."""
    size = f"least(size({x}), size({y}))"
    folded = [f"IF(size({o}) > {size}, zip_with(slice({o}, 1, {size}), slice({o}, {size} + 1, {size}), (u, v) -> u ^ v), {o})" for o in (x, y)]
    return f"aggregate(zip_with({folded[0]}, {folded[1]}, (u, v) -> bit_count(u ^ v)), 0, (total, k) -> total + k)"


def may_differ(an: str, bn: str, x: str, y: str, percent: int):
    """Whether parities allow ``percent``, as far as they are known: linked sets differ in few of their summed elements."""
    return F.expr(f"{x} IS NULL OR {y} IS NULL OR {100 + percent} * {apart(x, y)} <= {100 - percent} * ({an} + {bn})")


def may_link(an: str, bn: str, aleft: str, bleft: str, percent: int):
    """Whether sizes, and what is left of both sets from an element on, allow ``percent``."""
    return F.expr(f"100 * least({an}, {bn}) >= {percent} * greatest({an}, {bn}) AND {100 + percent} * least({aleft}, {bleft}) >= {percent} * ({an} + {bn})")
