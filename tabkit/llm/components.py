"""Connected components of an edge table, as joins and aggregates only."""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabkit.llm.prefixes import may_differ, may_link, turns_of
from tabkit.sources.workspace import Scratch, in_turn


TOGETHER = 20_000                                           # edges that one task turns in a moment
GAIN = 500                                                  # of so many members one at least must gain a link from a round of stars


def _stars(edges: DataFrame, larger: bool) -> DataFrame:
    """One star step: connect a node's larger (or its smaller and own) neighbours to the least one."""
    pairs = F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v")), F.struct(F.col("b").alias("u"), F.col("a").alias("v")))
    both = edges.select(F.inline(pairs)) if larger else edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    linked = both.join(least, "u")
    if larger:
        out = linked.filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        out = linked.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return out.filter("a <> b").distinct()


def components(edges: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """Every node of ``edges`` (a, b: long) with ``component``, the least node that it can reach.

    Large-star and small-star steps take turns until the edges form stars; each turn is written to
    ``scratch`` and its predecessor freed, so that two copies exist at most. The number of turns grows
    with the logarithm of the longest path. Up to ``TOGETHER`` edges are turned without a shuffle. A hot node's edges meet in a join that adaptive execution
    may split; its least neighbour is an aggregate. Loops and repeated edges change nothing; null ends
    are left out.
    """
    scratch = scratch or Scratch(edges.sparkSession, "components")
    edges = scratch.keep(edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"))
                         .filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    n = edges.count()
    while n:
        near = edges.coalesce(1) if n <= TOGETHER else edges
        # stars have one edge a node, and their centres none to a lesser node
        loose = near.select(F.col("a").alias("x"), F.lit(1).alias("out")).unionByName(near.select(F.col("b").alias("x"), F.lit(1).alias("out")).distinct())
        loose = loose.coalesce(1) if n <= TOGETHER else loose
        if not loose.groupBy("x").agg(F.sum("out").alias("out")).filter("out > 1").limit(1).count():
            break
        after = scratch.keep(_stars(_stars(near, True), False))
        scratch.free(edges)
        edges, n = after, after.count()
    labels = scratch.keep(edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()))
    scratch.free(edges)
    return labels


def least_per(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per key: the least by ``order``."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).filter("_rank = 1").drop("_rank")


def renamed(rows: DataFrame, name: str, check: str, pairs: DataFrame, members: DataFrame, scratch: Scratch):
    """Give a name of its own to each text where one 64-bit name stands for several.

    ``check`` is a second hash. Returns a function that renames a frame with both columns, and
    ``pairs`` (a, b, votes) and ``members`` (c, ...) with every text of a shared name in its place.
    """
    seen = rows.groupBy(name).agg(F.min(check).alias("p"), F.max(check).alias("q")).filter("p <> q").select(F.col(name).alias("shared"))
    seen = scratch.keep(seen)
    if not seen.limit(1).count():
        return (lambda df: df), pairs, members
    own = lambda df: F.xxhash64(df[name], df[check])

    def rename(df):
        return df.join(seen, df[name] == seen["shared"], "left").withColumn(name, F.when(F.col("shared").isNotNull(), own(df)).otherwise(df[name])).drop("shared")

    texts = scratch.keep(rows.join(seen, rows[name] == seen["shared"]).select("shared", own(rows).alias("text_name")).distinct())

    def replace(df, column):
        return (df.join(texts, df[column] == texts["shared"], "left").withColumn(column, F.coalesce("text_name", df[column])).drop("shared", "text_name"))

    among = texts.select("shared", F.col("text_name").alias("a")).join(texts.select("shared", F.col("text_name").alias("b")), "shared").filter("a < b")
    pairs = replace(replace(pairs, "a"), "b").unionByName(among.select("a", "b", F.lit(1).cast("long").alias("votes")))
    pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "votes")
    return rename, pairs, replace(members, "c")


def all_links(pairs: DataFrame, members: DataFrame, verify, scratch: Scratch, *, percent: int = 80, dense: int = 20) -> DataFrame:
    """Labels (node, component) of all that verified links among the candidates connect.

    ``pairs`` (a, b, votes) are candidates; ``members`` (group, c, n, left, low, odd) are groups too large to list
    in pairs, as ``prefix_candidates`` gives them. Each text first tries its candidate with most votes. Then,
    until nothing is left, candidates between different components are tried: all open pairs, and of groups
    with several components one star each while listing their pairs would take more than ``dense`` rows a
    member and stars still link one member in ``GAIN``, and after that all pairs that sizes, places and parities
    allow. The centre of a star is drawn anew in each round and group, so that a member of several groups meets
    different ones. Groups within one component are done, the next round reads the others alone. Components grow from those of the round before. What a round replaces is freed.
    Groups, and pairs by their first text, go in turns, so that a part of a round's shuffles is on disk at a time.
    """
    def checked(some):                                      # a filter on one end of pairs spares ``verify`` the other texts there
        turns = turns_of(some)
        return scratch.keep_turns(lambda i: verify(some.filter(in_turn("a", i, turns))), turns)

    best = (pairs.select(F.explode(F.array(F.struct(F.col("b").alias("c"), F.col("a").alias("d"), "votes"),
                                           F.struct(F.col("a").alias("c"), F.col("b").alias("d"), "votes"))).alias("x")).select("x.*")
            .groupBy("c").agg(F.max(F.struct("votes", F.col("d").alias("d"))).alias("top"))
            .select(F.least("c", "top.d").alias("a"), F.greatest("c", "top.d").alias("b")).distinct())
    tried = scratch.keep(best)
    links = checked(tried)
    labels = components(links, scratch)
    scratch.free(links)
    grouped, open_groups, turns = members.limit(1).count() > 0, None, turns_of(members)
    for turn in count():
        def mark(df, c, labels=labels):
            own = labels.select(F.col("node").alias(c), F.col("component").alias(f"{c}_label"))
            return df.join(own, c, "left").withColumn(f"{c}_label", F.coalesce(f"{c}_label", c))

        more = mark(mark(pairs.select("a", "b"), "a"), "b").filter("a_label <> b_label").select("a", "b")
        crowded, several, listed, held = False, None, None, 0
        if grouped:
            draw = F.xxhash64(F.lit(turn), "group", "c")
            of_turn = lambda df, i: df.filter(in_turn("group", i, turns))

            def uneven(i, members=members, mark=mark, draw=draw, of_turn=of_turn):
                return mark(of_turn(members, i), "c").groupBy("group").agg(
                    F.min("c_label").alias("p"), F.max("c_label").alias("q"), F.count("*").alias("size"),
                    F.min(F.struct(draw.alias("draw"), "c_label", "c", "n", "left", "odd")).alias("centre")).filter("p <> q").select("group", "centre", "size")

            several = scratch.keep_turns(uneven, turns)
            own = scratch.keep_turns(lambda i: mark(of_turn(members, i), "c").join(several.select("group"), "group"), turns)  # noqa: B023
            scratch.free(open_groups)
            open_groups, members = own, own.drop("c_label")
            total = several.agg(F.sum("size").alias("n"), F.sum(F.col("size") * F.col("size")).alias("pairs")).first()
            held = total["n"] or 0
            crowded = bool(held) and total["pairs"] > dense * held
            fields = (("c", ""), ("n", "n"), ("left", "left"), ("c_label", "l"), ("odd", "odd"))
            side = lambda x: [F.col(c).alias(f"{x}{n}") for c, n in fields]
            open_ = F.expr("xl <> yl") & may_link("xn", "yn", "xleft", "yleft", percent) & may_differ("xn", "yn", "xodd", "yodd", percent)

            def of_groups(i, crowded=crowded, several=several, own=own, of_turn=of_turn, side=side, fields=fields, open_=open_):
                mine = of_turn(own, i)
                if crowded:
                    centre = of_turn(several, i).select("group", *(F.col("centre")[c].alias(f"x{n}") for c, n in fields))
                    met = centre.join(mine.select("group", *side("y")), (centre["group"] == mine["group"]) & open_)
                else:
                    one, other = (mine.select(F.col("group").alias(f"{x}group"), F.col("low").alias(f"{x}low"), *side(x)) for x in "xy")
                    met = one.join(other, F.expr("xgroup = ygroup AND x < y AND NOT (xlow AND ylow)") & open_)
                return met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()

            listed = scratch.keep_turns(of_groups, turns)
            more = more.unionByName(listed)
        new = scratch.keep(more.distinct().join(tried, ["a", "b"], "left_anti"), heavy=grouped)
        scratch.free(several, listed)
        if not new.limit(1).count():
            scratch.free(new)
            if not crowded:
                scratch.free(tried, open_groups)
                return labels
            dense = 1 << 62                                 # the stars are exhausted: list what is left
            continue
        found = checked(new)
        gained = found.count()
        if gained:
            grown = components(labels.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(found.select("a", "b")), scratch)
            scratch.free(labels)
            labels = grown
        scratch.free(found)
        if not crowded:
            scratch.free(new, tried, open_groups)
            return labels
        dense = dense if GAIN * gained > held else 1 << 62
        both = scratch.keep(tried.unionByName(new))
        scratch.free(tried, new)
        tried = both
