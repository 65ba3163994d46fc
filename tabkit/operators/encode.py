"""Encoders, scalers and transformations: fitted on one frame, applied to any other."""

from __future__ import annotations

from dataclasses import dataclass
from math import ceil

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabkit.functions.scalars import hash_unit, harmonics, month_name, weekday_name, year_month
from tabkit.operators.agg import freq, mode_of
from tabkit.operators.neighbors import knn_join
from tabkit.operators.order import SPAN_ROWS, null_safe_join, quantiles, with_position
from tabkit.sources.workspace import Scratch

PATH_ROWS = 40_000_000           # rows that a step of the landmarks' paths lists in one turn


@dataclass
class LevelTable:
    """Value per category level, applied by a join. Spark broadcasts the table when it is
    small and splits a hot level of the rows when it is not; it also joins to a stream."""

    col: str
    out: str
    table: DataFrame                 # columns: col, out
    default: float | int | str | None = None

    def apply(self, df: DataFrame) -> DataFrame:
        side = self.table.select(F.col(self.col), F.col(self.out).alias("_code"))
        got = F.col("_code") if self.default is None else F.coalesce(F.col("_code"), F.lit(self.default))
        return df.join(side, self.col, "left").withColumn(self.out, got).drop("_code")


def label_encoder(df: DataFrame, col: str, out: str | None = None, span_rows: int = SPAN_ROWS) -> LevelTable:
    """Codes 0.. of the levels in sorted order. Levels are deduplicated before they are ranked."""
    levels = df.select(col).filter(F.col(col).isNotNull()).distinct()
    out = out or f"{col}_code"
    coded = with_position(levels, [F.col(col)], name="_at", span_rows=span_rows)
    return LevelTable(col, out, coded.select(col, (F.col("_at") - 1).cast("int").alias(out)))


def binary_encode(df: DataFrame, spec: dict) -> DataFrame:
    """1 where the column has the given level, 0 elsewhere; NULL stays."""
    return df.withColumns({
        c: F.when(F.col(c) == v, 1).when(F.col(c).isNotNull(), 0) for c, v in spec.items()})


@dataclass
class Scaler:
    """Centre and spread per column as literals: applying it is a plain projection."""

    centre: dict[str, float]
    spread: dict[str, float]

    def apply(self, df: DataFrame) -> DataFrame:
        return df.withColumns({
            c: (F.col(c) - F.lit(self.centre[c])) / F.lit(self.spread[c]) for c in self.centre})


def standard_scaler(train: DataFrame, cols) -> Scaler:
    """Mean and population standard deviation (1 where it is zero)."""
    row = train.agg(*[e for c in cols for e in (F.avg(c).alias(f"m_{c}"), F.stddev_pop(c).alias(f"s_{c}"))]).first()
    return Scaler({c: float(row[f"m_{c}"] or 0.0) for c in cols}, {c: float(row[f"s_{c}"] or 1.0) for c in cols})


def robust_scaler(train: DataFrame, cols, span_rows: int = SPAN_ROWS) -> Scaler:
    """Exact median and interquartile range (1 where it is zero)."""
    row = quantiles(train, cols, [0.25, 0.5, 0.75], span_rows=span_rows).first()
    qs = {c: row[c] or [0.0, 0.0, 1.0] for c in cols}
    return Scaler({c: float(q[1]) for c, q in qs.items()}, {c: float(q[2] - q[0]) or 1.0 for c, q in qs.items()})


BOX_COX_GRID = tuple(round(-2.0 + 0.1 * i, 1) for i in range(41))


def _box_cox(x: Column, lam: float) -> Column:
    return F.ln(x) if abs(lam) < 1e-12 else (F.pow(x, F.lit(lam)) - 1.0) / F.lit(lam)


def box_cox_lambda(df: DataFrame, cols, grid=BOX_COX_GRID, refine: int = 0, shift: float = 1.0) -> dict[str, float]:
    """Exponent of largest likelihood per column, all columns and candidates in one aggregate;
    each refinement repeats it on a ten times finer grid around the best."""
    grids = {c: list(grid) for c in cols}
    best: dict[str, float] = {}
    step = grid[1] - grid[0] if len(grid) > 1 else 0.0
    for turn in range(refine + 1):
        row = df.agg(*[e for c in cols for e in (
            F.count(c).alias(f"{c}|n"), F.sum(F.ln(F.col(c) + shift)).alias(f"{c}|log"),
            *[F.var_pop(_box_cox(F.col(c) + shift, lam)).alias(f"{c}|{i}") for i, lam in enumerate(grids[c])])]).first()
        for c in cols:
            def llf(i, lam, c=c):
                var = row[f"{c}|{i}"]
                return -np.inf if not var else (lam - 1) * row[f"{c}|log"] - row[f"{c}|n"] / 2.0 * np.log(var)
            best[c] = max(enumerate(grids[c]), key=lambda p: llf(*p))[1]
            step_now = step / 10 ** (turn + 1)
            grids[c] = [best[c] + step_now * j for j in range(-10, 11)]
    return best


def box_cox(df: DataFrame, cols, lam: dict | None = None, shift: float = 1.0, refine: int = 2) -> DataFrame:
    """Box-Cox transform of x + shift with given or likeliest exponents."""
    lam = lam or box_cox_lambda(df, cols, refine=refine, shift=shift)
    return df.withColumns({c: _box_cox(F.col(c) + shift, lam[c]) for c in cols})


def james_stein(train: DataFrame, col: str, target: str, out: str | None = None) -> LevelTable:
    """Target mean per level, shrunk to the overall mean; unseen and NULL levels get the latter."""
    out = out or f"{col}_js"
    prior = train.agg(F.avg(target).alias("m"), F.var_samp(target).alias("v")).first()
    m, v = float(prior["m"] or 0.0), float(prior["v"] or 0.0)
    levels = train.filter(F.col(col).isNotNull()).groupBy(col).agg(
        F.avg(target).alias("_m"), F.coalesce(F.var_samp(target), F.lit(0.0)).alias("_v"))
    k = levels.count()
    if k <= 1 or v == 0.0:
        value = F.lit(m)
    else:
        shrink = 1.0 - F.col("_v") / (F.col("_v") + F.lit(v)) * F.lit((k - 3.0) / (k - 1.0))
        s = F.greatest(F.lit(0.0), F.least(F.lit(1.0), shrink))
        value = s * F.col("_m") + (1.0 - s) * F.lit(m)
    return LevelTable(col, out, levels.select(col, value.alias(out)), m)


def fourier(df: DataFrame, date: str, period: float = 365, n: int = 5) -> DataFrame:
    """sin and cos of the first n harmonics of the day of year."""
    return df.withColumns(harmonics(F.dayofyear(date), period, n))


def calendar_features(df: DataFrame, date: str) -> DataFrame:
    d = F.col(date)
    return df.withColumns({"day_name": weekday_name(d), "month": month_name(d), "year": F.year(d),
                           "yr_month": year_month(d), "yday": F.dayofyear(d)})


def log_scale(df: DataFrame, cols) -> DataFrame:
    return df.withColumns({c: F.log1p(F.col(c)) for c in cols})


def unlog(df: DataFrame, cols) -> DataFrame:
    return df.withColumns({c: F.expm1(F.col(c)) for c in cols})


def weight_features(df: DataFrame, importances: dict, k: int = 3, weight: float = 1000.0) -> DataFrame:
    """Multiply the k most important columns by a weight."""
    top = sorted(importances, key=lambda c: (-importances[c], c))[:k]
    return df.withColumns({c: F.col(c) * F.lit(weight) for c in top})


@dataclass
class KeptLevels:
    """Frequent levels per column; anything else becomes the fallback text."""

    col: str
    levels: DataFrame
    other: str = "Other"

    def apply(self, df: DataFrame) -> DataFrame:
        side = self.levels.select(F.col(self.col), F.lit(True).alias("_kept"))
        return df.join(side, self.col, "left").withColumn(
            self.col, F.when(F.col("_kept"), F.col(self.col)).when(F.col(self.col).isNotNull(), F.lit(self.other))
        ).drop("_kept").select(*df.columns)


def lump_rare(train: DataFrame, col: str, threshold: float = 0.05, other: str = "Other") -> KeptLevels:
    """Levels with at least the given share of the training rows; the rest are lumped."""
    known = train.filter(F.col(col).isNotNull())
    return KeptLevels(col, freq(known, col, pct=True).filter(F.col("pct") >= threshold * 100.0).select(col), other)


def align_levels(train: DataFrame, test: DataFrame, col: str) -> DataFrame:
    """Test rows with levels unknown to the training rows replaced by the training mode."""
    mode = mode_of(train, col).select("mode").scalar()
    seen = train.select(col).distinct().withColumn("_seen", F.lit(True))
    return test.join(seen, col, "left").withColumn(
        col, F.when(F.col("_seen") | F.col(col).isNull(), F.col(col)).otherwise(mode)).select(*test.columns)


def smote(df: DataFrame, label: str, key: str, features: str, k: int = 5, seed: int = 0) -> DataFrame:
    """Oversample every class to the size of the largest: new points lie between a row and one
    of its k nearest neighbours of the same class.

    Each row makes its even share of the missing points, so no class passes through one task.
    Returns the new rows: key of the seed row, running number, label and feature array.
    """
    classes = df.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    largest = classes.agg(F.max("_n")).scalar()
    deficits = classes.withColumn("_need", largest - F.col("_n")).filter("_need > 0")
    lone = deficits.filter("_n = 1").limit(1).collect()
    if lone:
        raise ValueError(f"class {lone[0][label]} has one row and so no neighbours to place points between")
    rows = df.select(key, label, F.col(features).cast("array<double>").alias("_x"))
    minority = null_safe_join(rows, deficits, [label], "inner")
    near = knn_join(minority, minority.withColumnRenamed(key, "_nb"), key, "_nb", "_x", k, within=label,
                    exclude_same=True)
    near = near.groupBy(key).agg(F.count(F.lit(1)).alias("_kn"), F.map_from_entries(
        F.collect_list(F.struct("rank", "_nb"))).alias("_near"))
    # Rows of a class take turns: position decides who makes one point more than the others.
    placed = with_position(minority, [F.md5(F.col(key).cast("string")), F.col(key)], [label], "_at")
    share = F.floor(F.col("_need") / F.col("_n")) + F.when(F.col("_at") <= F.col("_need") % F.col("_n"), 1).otherwise(0)
    seeds = placed.withColumn("_c", share.cast("int")).filter("_c > 0").join(near, key)
    made = seeds.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("_c"))))
    pick = 1 + F.floor(hash_unit(F.col(key), F.col("copy"), seed=seed) * F.col("_kn")).cast("int")
    made = made.withColumn("_nb", F.element_at("_near", pick)).withColumn(
        "u", hash_unit(F.col(key), F.col("copy"), seed=seed + 1))
    other = rows.select(F.col(key).alias("_nb"), F.col("_x").alias("_y"))
    point = F.zip_with("_x", "_y", lambda a, b: a + (b - a) * F.col("u"))
    return made.join(other, "_nb").select(F.col(key), "copy", F.col("_nb").alias("neighbor"), label, point.alias(features))


def landmark_isomap(df: DataFrame, key: str, features: str, components: int = 2, n_neighbors: int = 10,
                    n_landmarks: int = 16) -> DataFrame:
    """Landmark Isomap: neighbour graph, shortest paths from a few landmarks, classical scaling
    of the landmarks, and placement of every row from its landmark distances.

    Paths grow by joins of the improved distances with the edges until nothing improves. If
    some row is not reached by every landmark, the graph is not connected, and the number of
    neighbours doubles until it is.
    """
    rows = df.select(F.col(key).alias("id"), F.col(features).cast("array<double>").alias("x"))
    scratch = Scratch(df.sparkSession, "isomap")
    rows = scratch.keep(rows)
    total = rows.count()
    n_landmarks = min(n_landmarks, total)
    marks = [r["id"] for r in rows.orderBy(F.md5(F.col("id").cast("string")), "id").limit(n_landmarks).collect()]
    k = min(n_neighbors, max(total - 1, 1))
    while True:
        dist = _landmark_paths(rows, marks, k, scratch)
        reached = dist.groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") == n_landmarks).count()
        if reached == total or k >= total - 1:
            break
        scratch.free(dist)
        k = min(2 * k, total - 1)
    index = {m: i for i, m in enumerate(marks)}
    square = np.zeros((n_landmarks, n_landmarks))
    for r in dist.filter(F.col("id").isin(marks)).collect():          # landmarks by landmarks
        square[index[r["landmark"]], index[r["id"]]] = r["d"] ** 2
    square = (square + square.T) / 2.0
    centring = np.eye(n_landmarks) - 1.0 / n_landmarks
    values, vectors = np.linalg.eigh(-0.5 * centring @ square @ centring)
    use = [i for i in np.argsort(values)[::-1][:components] if values[i] > 1e-9]
    pseudo = np.array([vectors[:, i] / np.sqrt(values[i]) for i in use])
    mean_sq = square.mean(axis=1)
    coords = []
    for c in range(components):
        if c >= len(use):
            coords.append(F.lit(0.0).alias(f"iso_{c + 1}"))
            continue
        weights = F.create_map(*[F.lit(v) for m in marks for v in (m, float(pseudo[c, index[m]]))])
        means = F.create_map(*[F.lit(v) for m in marks for v in (m, float(mean_sq[index[m]]))])
        term = weights[F.col("landmark")] * (F.col("d") * F.col("d") - means[F.col("landmark")])
        coords.append((F.lit(-0.5) * F.sum(term)).alias(f"iso_{c + 1}"))
    return dist.groupBy(F.col("id").alias(key)).agg(*coords)


def _landmark_paths(rows: DataFrame, marks, k: int, scratch: Scratch) -> DataFrame:
    """Landmarks take turns, so that the disk holds the steps of a few; a step's copy goes once the next one stands."""
    near = knn_join(rows, rows.withColumnRenamed("id", "nb"), "id", "nb", "x", k, exclude_same=True)
    one_way = near.select(F.col("id").alias("a"), F.col("nb").alias("b"), F.col("distance").alias("w"))
    edges = scratch.keep(one_way.union(one_way.select("b", "a", "w")).groupBy("a", "b").agg(F.min("w").alias("w")), heavy=True)
    steps = len(marks) * edges.count()                                  # rows that a step lists at most
    turns, held = max(1, min(len(marks), ceil(steps / PATH_ROWS))), []

    def grown(turn: int) -> DataFrame:
        scratch.free(*held)
        start = rows.filter(F.col("id").isin(marks[turn::turns])).select(F.col("id").alias("landmark"), "id", F.lit(0.0).alias("d"))
        held[:] = [scratch.keep(start)]
        best = front = held[0]
        while not front.isEmpty():
            step = front.join(edges, front["id"] == edges["a"]).groupBy("landmark", F.col("b").alias("id")).agg(
                F.min(F.col("d") + F.col("w")).alias("nd"))
            merged = scratch.keep(best.join(step, ["landmark", "id"], "full").select(
                "landmark", "id", F.least("d", "nd").alias("d"),
                (F.col("nd").isNotNull() & (F.col("d").isNull() | (F.col("nd") < F.col("d") - 1e-12))).alias("better")), heavy=20 * steps > PATH_ROWS)
            scratch.free(*held)
            held[:] = [merged]
            best, front = merged.drop("better"), merged.filter("better").drop("better")
        return best

    out = scratch.keep_turns(grown, turns)
    scratch.free(edges, *held)
    return out

