"""Exact k-nearest-neighbour join without a cross join.

Reference points ("pivots") split the rows of a group into cells of about ``cell_rows`` rows; they
stand in a tree of two levels, so that finding a row's cell takes about twice the root of their number.
The join goes in two rounds. First each query meets its nearest cells, until they hold k rows; the k-th
distance found bounds where better ones may be. Then only queries with a cell within that bound visit it,
by the triangle inequality. Cells larger than a block are cut into blocks on both sides, so one task
never holds more than ``block_rows`` rows of either side, and each block returns only its k best per
query. Where bounds rule out few cells, as with many columns, the second round visits large blocks of cells at
once instead, so that a row is sent once for each block. Its queries take turns, and the disk holds a turn's copies: a
multiple of the rows. Nothing is sampled or capped: pivots only decide what meets first.
"""

from __future__ import annotations

from math import ceil, sqrt

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StructField, StructType

from tabkit.functions.scalars import hash_bucket, hash_unit
from tabkit.sources.workspace import Scratch, in_turn

MOST_COPIES = 8                  # of each row that one turn sends on average
FEW_COPIES = 200_000             # of rows that need no turns
WIDE = 4                         # blocks that bounds do not thin out are so many times larger
CHUNK = 1 << 21                  # distances at a time
PIVOT_BYTES = 64 << 20           # what the pivots may take in memory; beyond it cells grow and are cut into blocks


def _matrix(column) -> np.ndarray:
    """Rows of a list column; NULL in a list is NaN."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if not len(column):
        return np.zeros((0, 0))
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1)


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances of all rows of a to all rows of b, over the columns that a row of a has, as sums of
    squared differences (no cancellation)."""
    out, masked = np.zeros((len(a), len(b))), np.isnan(a).any(0)
    for j in range(a.shape[1]):
        gap = a[:, j][:, None] - b[:, j][None, :]
        if masked[j]:
            gap[np.isnan(a[:, j])] = 0.0
        gap *= gap
        out += gap
    return np.sqrt(out, out=out)


def _k_nearest(x: np.ndarray, bx: np.ndarray, k: int, skip: np.ndarray, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row of x, row of bx and distance of each row's k nearest that it does not skip and that lie within its bound; ties go to the first.

    A matrix product tells which may be among them, up to its error; their distances are summed like those of ``_distances``.
    """
    held = np.isnan(x)
    filled, own = np.where(held, 0.0, x), (bx * bx).sum(1)
    with np.errstate(over="ignore", invalid="ignore"):
        norms = (~held).astype(float) @ (bx * bx).T if held.any() else own[None, :]
        size = (filled * filled).sum(1)
        error = 1e-11 * (size + (own.max() if len(own) else 0.0))
    if np.isfinite(error).all():
        rough = size[:, None] + norms - 2.0 * (filled @ bx.T)
        rough[skip] = np.inf
        limit = bound * bound
        loose = np.flatnonzero(~np.isfinite(limit))
        if len(loose) and bx.shape[0] > k:
            limit[loose] = np.partition(rough[loose], k - 1, axis=1)[:, k - 1]
        row, spot = np.nonzero((rough <= limit[:, None] * (1 + 1e-9) + 2 * error[:, None]) & ~skip)
    else:                                                               # squares too large for a product
        row, spot = np.nonzero(~skip)
    d = np.zeros(len(row))
    for j in range(x.shape[1]):
        gap = x[row, j] - bx[spot, j]
        gap[held[row, j]] = 0.0
        gap *= gap
        d += gap
    np.sqrt(d, out=d)
    order = np.lexsort((spot, d, row))
    order = order[np.isfinite(d[order])]
    row, spot, d = row[order], spot[order], d[order]
    first = np.searchsorted(row, row, side="left")
    best = np.arange(len(row)) - first < k
    return row[best], spot[best], d[best]


class PivotTree:
    """Pivots of one group below about as many tops as a top has children."""

    def __init__(self, points: np.ndarray):
        self.points = points
        self.tops = points[:ceil(sqrt(len(points)))]
        parent = _distances(points, self.tops).argmin(1)
        self.children = [np.flatnonzero(parent == t) for t in range(len(self.tops))]
        self.r_min = self.r_max = self.count = np.zeros(len(points))

    def measured(self, cells: np.ndarray, count: np.ndarray, r_min: np.ndarray, r_max: np.ndarray) -> PivotTree:
        """With how many rows each cell has, and the least and largest distance of its rows to the pivot."""
        self.count, self.r_min, self.r_max = np.zeros((3, len(self.points)))
        self.count[cells], self.r_min[cells], self.r_max[cells] = count, r_min, r_max
        return self

    def _by_top(self, x: np.ndarray):
        to_top = _distances(x, self.tops)
        to_top[:, [i for i, c in enumerate(self.children) if not len(c)]] = np.inf
        nearest = to_top.argmin(1)
        for t in np.unique(nearest):
            rows = np.flatnonzero(nearest == t)
            yield rows, self.children[t], _distances(x[rows], self.points[self.children[t]])

    def home(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each row's cell, and the distance to its pivot."""
        cell, r = np.zeros(len(x), np.int64), np.zeros(len(x))
        for rows, children, d in self._by_top(x):
            best = d.argmin(1)
            cell[rows], r[rows] = children[best], d[np.arange(len(rows)), best]
        return cell, r

    def near(self, x: np.ndarray, wanted: int) -> list[np.ndarray]:
        """The nearest cells below a query's nearest top until they hold the wanted number of rows."""
        out: list = [None] * len(x)
        for rows, children, d in self._by_top(x):
            order = children[np.argsort(d, axis=1, kind="stable")]
            enough = (np.cumsum(self.count[order], axis=1) < wanted).sum(1) + 1
            for i, cells, n in zip(rows, order, enough):
                out[i] = cells[:n]
        return out

    def far(self, x: np.ndarray, bound: np.ndarray, seen: list) -> list[np.ndarray]:
        """Cells other than the seen ones that may hold a row within a query's bound."""
        limit = bound * (1 + 1e-9) + 1e-12
        whole = ~np.isnan(x).any(1)
        found: list[list] = [[] for _ in range(len(x))]
        to_top = _distances(x, self.tops)
        for t, children in enumerate(self.children):
            if not len(children):
                continue
            reach = (_distances(self.points[children], self.tops[t:t + 1])[:, 0] + self.r_max[children]).max()
            rows = np.flatnonzero(to_top[:, t] - reach <= limit)
            if not len(rows):
                continue
            d = _distances(x[rows], self.points[children])
            # A query without some columns is nearer than in full, so that only the outer radius tells.
            least = np.maximum(d - self.r_max[children], np.where(whole[rows][:, None], self.r_min[children] - d, 0.0))
            for i, cells in zip(rows, (least <= limit[rows][:, None]) & (self.count[children] > 0)):
                found[i].append(children[cells])
        return [np.setdiff1d(np.concatenate(f), s) if f else np.zeros(0, np.int64) for f, s in zip(found, seen)]


def _lists(rows: list) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int32)
    flat = np.concatenate(rows) if rows else np.zeros(0)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.astype(np.int32)))


def _by_group(batch: pa.RecordBatch):
    """Row numbers of each group of a batch."""
    coded = batch.column("g").dictionary_encode()
    codes = coded.indices.to_numpy()
    for i, name in enumerate(coded.dictionary.to_pylist()):
        yield name, np.flatnonzero(codes == i)


def knn_join(queries: DataFrame, base: DataFrame, query_key: str, base_key: str, features: str, k: int,
             within: str | None = None, exclude_same: bool = False, cell_rows: int = 512,
             block_rows: int = 4096) -> DataFrame:
    """The k nearest base rows of every query row: (query_key, base_key, distance, rank).

    ``features`` names an array column on both sides, ``within`` a column that must be equal (NULL
    equals NULL), and ``exclude_same`` leaves out the row with the query's own key. Ties go to the smaller
    key. NULLs within a query's features are left out of its distances; base rows with one, and rows without
    features, take no part. Keys of queries must differ.
    """
    spark = queries.sparkSession
    group = F.coalesce(F.concat(F.lit("="), F.col(within).cast("string")), F.lit("")) if within else F.lit("")
    queries = queries.select(F.col(query_key).alias("q"), F.col(features).cast("array<double>").alias("x"), group.alias("g")).filter("x IS NOT NULL")
    base = base.select(F.col(base_key).alias("b"), F.col(features).cast("array<double>").alias("x"), group.alias("g")).filter(
        F.col("x").isNotNull() & ~F.exists("x", lambda v: v.isNull() | F.isnan(v)))
    scratch = Scratch(spark, "near")
    base = scratch.keep(base, heavy=True)
    q_field, b_field = queries.schema["q"], base.schema["b"]
    x_field, g_field = base.schema["x"], base.schema["g"]
    out_schema = StructType([StructField(query_key, q_field.dataType), StructField(base_key, b_field.dataType),
                             StructField("distance", DoubleType())])

    width, total = base.agg(F.max(F.size("x")), F.count(F.lit(1))).first()
    cell_rows = max(cell_rows, ceil((total or 0) * (width or 0) * 8 / PIVOT_BYTES))
    # Groups of more than one cell are at most one for each cell_rows rows, and so are the pivots.
    large = base.groupBy("g").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > cell_rows).select("g") if within else None

    def of_large(df: DataFrame) -> DataFrame:
        return df.join(large, "g", "left_semi") if within else df

    drawn = base.filter(hash_unit(F.col("b"), seed=17) < 1.0 / cell_rows)
    picked: dict[str, list] = {}
    for r in of_large(drawn).select("g", "b", "x").orderBy("g", "b").collect() if (total or 0) > cell_rows else ():
        picked.setdefault(r["g"], []).append(r["x"])
    pivots = spark.sparkContext.broadcast({g: np.array(x, float) for g, x in picked.items()})

    def to_cells(batches):
        trees = {g: PivotTree(p) for g, p in pivots.value.items()}
        for batch in batches:
            x, cell, r = _matrix(batch.column("x")), np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows)
            for g, rows in _by_group(batch):
                if g in trees:
                    cell[rows], r[rows] = trees[g].home(x[rows])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int32)), pa.array(r)], ["b", "x", "g", "cell", "r"])

    if picked:
        celled = scratch.keep(base.mapInArrow(to_cells, StructType([b_field, x_field, g_field]).add("cell", IntegerType()).add("r", DoubleType())))
    else:
        celled = base.withColumns({"cell": F.lit(0), "r": F.lit(0.0)})
    sizes = celled.groupBy("g", "cell").agg(F.count(F.lit(1)).alias("n"), F.min("r").alias("r_min"), F.max("r").alias("r_max"))
    measures: dict[str, list] = {}
    for r in of_large(sizes).collect() if picked else ():               # one row per pivot
        measures.setdefault(r["g"], []).append((r["cell"], r["n"], r["r_min"], r["r_max"]))
    shapes = spark.sparkContext.broadcast({g: np.array(m).T for g, m in measures.items()})

    def measured_trees() -> dict[str, PivotTree]:
        return {g: PivotTree(p).measured(shapes.value[g][0].astype(int), *shapes.value[g][1:]) for g, p in pivots.value.items() if g in shapes.value}

    def to_near(batches):
        trees = measured_trees()
        for batch in batches:
            x, cells = _matrix(batch.column("x")), [np.zeros(1, np.int64)] * batch.num_rows
            for g, rows in _by_group(batch):
                if g in trees:
                    for i, c in zip(rows, trees[g].near(x[rows], k + exclude_same)):
                        cells[i] = c
            yield pa.RecordBatch.from_arrays([*batch.columns, _lists(cells)], ["q", "x", "g", "cells"])

    def to_far(batches):
        trees = measured_trees()
        for batch in batches:
            x, cells = _matrix(batch.column("x")), [np.zeros(0, np.int64)] * batch.num_rows
            bound, seen = batch.column("bound").fill_null(np.inf).to_numpy(), batch.column("cells").to_pylist()
            for g, rows in _by_group(batch):
                if g in trees:
                    for i, c in zip(rows, trees[g].far(x[rows], bound[rows], [seen[i] for i in rows])):
                        cells[i] = c
            open_ = np.array([len(c) > 0 for c in cells], bool)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("q", "x", "g")), _lists(cells), batch.column("cells"), pa.array(bound)],
                                             ["q", "x", "g", "cells", "seen", "bound"]).filter(pa.array(open_))

    def nearest(left: pa.Table, right: pa.Table) -> pa.Table:
        found = []
        if left.num_rows and right.num_rows:
            right = right.take(pc.sort_indices(right.column("b")))
            bx, bkeys, x = _matrix(right.column("x")), right.column("b").combine_chunks(), _matrix(left.column("x"))
            own = left.column("q").to_numpy(zero_copy_only=False)
            theirs = bkeys.to_numpy(zero_copy_only=False)
            cells, bound = right.column("cell").to_numpy(), left.column("bound").to_numpy()
            seen = left.column("seen").combine_chunks()
            ends = np.concatenate([[0], np.cumsum(seen.value_lengths().to_numpy(zero_copy_only=False))]).astype(int)
            visited = seen.flatten().to_numpy(zero_copy_only=False)
            size = max(1, CHUNK // len(bx))
            for start in range(0, len(x), size):
                stop = min(start + size, len(x))
                skip = np.zeros((stop - start, len(bx)), bool)
                if exclude_same:
                    skip |= own[start:stop][:, None] == theirs[None, :]
                lengths = np.diff(ends[start:stop + 1])
                for at in range(lengths.max()):                         # the cells of the first round, which are few
                    asks = np.flatnonzero(lengths > at)
                    skip[asks] |= cells[None, :] == visited[ends[start + asks] + at][:, None]
                row, spot, d = _k_nearest(x[start:stop], bx, k, skip, bound[start:stop])
                found.append((start + row, spot, d))
        rows = [np.concatenate(x) for x in zip(*found)] if found else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        return pa.table({query_key: left.column("q").take(pa.array(rows[0])), base_key: right.column("b").take(pa.array(rows[1])), "distance": rows[2]})

    def slot(key, parts, seed):
        return F.pmod(hash_bucket(F.col(key), buckets=1 << 20, seed=seed), F.col(parts))

    best = W.partitionBy(query_key).orderBy("distance", base_key)

    def visit(asked: DataFrame, merge: int = 1, most: int = block_rows) -> DataFrame:
        """The k best of the cells that each query asks for, or of runs of so many cells with one, without those it has seen."""
        runs = F.array_distinct(F.transform("cells", lambda c: F.floor(c / merge).cast("int")))
        asked = asked.select("q", "x", "g", "seen", "bound", F.explode(runs).alias("run"))
        run = F.floor(F.col("cell") / merge).cast("int").alias("run")
        held = sizes.groupBy("g", run).agg(F.sum("n").alias("n"))
        loads = asked.groupBy("g", "run").agg(F.count(F.lit(1)).alias("nq"))
        plan = held.join(loads, ["g", "run"]).select("g", "run", F.ceil(F.col("n") / most).cast("int").alias("nb"),
                                                     F.ceil(F.col("nq") / most).cast("int").alias("nqb"))
        left = asked.join(plan, ["g", "run"]).select(
            "g", "run", slot("q", "nqb", 1).alias("i"), F.explode(F.sequence(F.lit(0), F.col("nb") - 1)).alias("j"), "q", "x", "seen", "bound")
        right = celled.withColumn("run", run).join(plan, ["g", "run"]).select(
            "g", "run", F.explode(F.sequence(F.lit(0), F.col("nqb") - 1)).alias("i"), slot("b", "nb", 2).alias("j"), "b", "x", "cell")
        block = ["g", "run", "i", "j"]
        return left.groupBy(*block).cogroup(right.groupBy(*block)).applyInArrow(nearest, out_schema)

    def cut(pairs: DataFrame) -> DataFrame:
        return pairs.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)

    fresh = {"seen": F.array().cast("array<int>"), "bound": F.lit(float("inf"))}
    if not picked:
        return cut(visit(scratch.keep(queries.withColumn("cells", F.array(F.lit(0)))).withColumns(fresh))).select(query_key, base_key, "distance", "rank")
    near = scratch.keep(queries.mapInArrow(to_near, StructType([q_field, queries.schema["x"], queries.schema["g"]]).add("cells", ArrayType(IntegerType()))))
    first = scratch.keep(cut(visit(near.withColumns(fresh))), heavy=True)
    bounds = first.filter(F.col("rank") == k).select(F.col(query_key).alias("q"), F.col("distance").alias("bound"))
    asked = of_large(near).join(bounds, "q", "left").select("q", "x", "g", "cells", "bound")
    far = scratch.keep(asked.mapInArrow(to_far, StructType([*near.schema.fields, StructField("seen", ArrayType(IntegerType())), StructField("bound", DoubleType())])), heavy=True)
    cells = sum(len(m) for m in measures.values())
    wide = block_rows * WIDE
    merge = max(1, wide * cells // max(total, 1))
    n, per_cell, per_run = far.agg(F.count(F.lit(1)), F.sum(F.size("cells")), F.sum(F.size(F.array_distinct(F.transform("cells", lambda c: F.floor(c / merge).cast("int")))))).first()
    # Fewer copies of queries pay for more distances where a run stands for many asked cells.
    merge, most, copies = (merge, wide, per_run) if n and 4 * per_run <= per_cell else (1, block_rows, per_cell or 0)
    turns = max(1, ceil(2 * copies / max(FEW_COPIES, MOST_COPIES * (n or 0))))

    def better(turn: int) -> DataFrame:
        mine = visit(far.filter(in_turn("q", turn, turns)), merge, most)
        return cut(first.drop("rank").filter(in_turn(query_key, turn, turns)).unionByName(mine)).select(query_key, base_key, "distance", "rank")

    out = scratch.keep_turns(better, turns)
    scratch.free(base, celled, near, first, far)
    return out
