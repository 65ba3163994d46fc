"""Filling missing values: by statistics, neighbours, interpolation or a model."""

from __future__ import annotations

from dataclasses import replace
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabkit.functions.scalars import hash_text, round_even
from tabkit.operators import joins
from tabkit.operators.agg import mode_of
from tabkit.operators.neighbors import knn_join
from tabkit.operators.order import (SPAN_ROWS, as_columns, fill, medians, needs_split, null_safe_join, over_rows,
                                    with_position)
from tabkit.sources.workspace import checkpointed


def impute(df: DataFrame, cols, how: str, by=(), ties: str = "smallest", order: str | None = None,
           span_rows: int = SPAN_ROWS) -> DataFrame:
    """Fill NULLs with the median, mean or mode of the column, overall or per group.

    The statistics are aggregates joined back, so a group of any size is never gathered.
    """
    cols, by = list(cols), list(by)
    if how == "mean":
        stats = df.groupBy(*by).agg(*[F.avg(c).alias(f"_fill_{c}") for c in cols])
    elif how == "median":
        stats = medians(df, cols, by, span_rows).withColumnsRenamed({c: f"_fill_{c}" for c in cols})
    elif how == "mode":
        out = df
        for c in cols:
            mode = mode_of(df, c, by, ties, order).drop("n").withColumnRenamed("mode", "_fill")
            out = null_safe_join(out, mode, by).withColumn(c, F.coalesce(c, "_fill")).drop("_fill")
        return out
    else:
        raise ValueError(f"unknown statistic {how!r}")
    out = null_safe_join(df, stats, by)
    return out.withColumns({c: F.coalesce(c, f"_fill_{c}") for c in cols}).drop(*[f"_fill_{c}" for c in cols])


def knn_impute(df: DataFrame, key: str, cols, k: int = 50, digits: int | None = None, **knn) -> DataFrame:
    """Fill NULLs with the weighted mean of the k nearest complete rows, weights exp(-distance).

    Columns are standardised; the distance uses the columns that a row has, so that rows with any
    pattern of gaps go through one nearest-neighbour join. To a row without any value all complete rows
    are equally near.
    """
    cols = list(cols)
    stats = df.agg(F.count(F.lit(1)).alias("_n"), *[e for c in cols for e in (
        F.avg(c).alias(f"m_{c}"), F.stddev_samp(c).alias(f"s_{c}"), F.count(c).alias(f"n_{c}"))]).first()
    gaps = [c for c in cols if stats[f"n_{c}"] < stats["_n"]]
    if not gaps:
        return df

    def z(c):
        sd = stats[f"s_{c}"]
        return (F.col(c).cast("double") - F.lit(stats[f"m_{c}"]).cast("double")) / F.lit(sd if sd else 1.0)

    known = reduce(lambda a, b: a + b, [F.col(c).isNotNull().cast("int") for c in cols])
    scaled = F.array(*[z(c) for c in cols]).alias("features")
    complete = df.filter(known == len(cols))
    query = df.filter((known > 0) & (known < len(cols))).select(F.col(key).alias("q_key"), scaled)
    pairs = knn_join(query, complete.select(F.col(key).alias("b_key"), scaled), "q_key", "b_key", "features", k, **knn)
    values = complete.select(F.col(key).alias("b_key"), *[F.col(c).cast("double").alias(f"_v_{c}") for c in gaps])
    weight = F.exp(-F.col("distance"))
    fills = pairs.join(values, "b_key").groupBy(F.col("q_key").alias(key)).agg(*[
        F.coalesce(F.sum(F.col(f"_v_{c}") * weight) / F.nullif(F.sum(weight), F.lit(0.0)), F.avg(f"_v_{c}")).alias(f"_f_{c}") for c in gaps])
    means = complete.agg(*[F.avg(c).cast("double").alias(c) for c in gaps]).select(F.struct("*")).scalar()
    out = df.join(fills, key, "left")

    def value(c):
        v = F.coalesce(F.col(f"_f_{c}"), F.when(known == 0, means[c]))
        return F.coalesce(F.col(c).cast("double"), v if digits is None else round_even(v, digits))

    return out.withColumns({c: value(c) for c in gaps}).select(*df.columns)


def interpolate(df: DataFrame, keys, order, col: str, how: str = "linear", digits: int | None = None,
                edges: bool = True, span_rows: int = SPAN_ROWS, split: bool | None = None) -> DataFrame:
    """Fill gaps of a series from the known values around them.

    ``how`` is 'linear', 'pchip' (shape-preserving cubic) or 'spline' (cubic spline that also
    extends past the ends). The abscissa is the row position within the key. With
    ``edges`` leading gaps take the first value and trailing gaps the last. Pass
    ``split=False`` for series that are short by construction (see ``windows``).
    """
    keys, order = list(keys), as_columns(order)
    if how == "spline":
        return _spline(df, keys, order, col, digits, span_rows, split)
    if split is None:
        split = needs_split(df, keys, span_rows)
    placed = with_position(df, order, keys, "_x", span_rows, split).withColumn("_y", F.col(col).cast("double"))
    knots = placed.filter("_y IS NOT NULL").select(*keys, "_x", "_y")
    if how == "pchip":
        knots = _pchip_slopes(knots, keys, span_rows, split)
    elif how == "linear":
        knots = knots.withColumn("_m", F.lit(0.0))
    else:
        raise ValueError(f"unknown interpolation {how!r}")
    knots = knots.select(*keys, "_x", F.struct("_x", "_y", "_m").alias("_prev"))
    marked = null_safe_join(placed, knots, [*keys, "_x"]).withColumn("_next", F.col("_prev"))
    at = [F.col("_x")]
    marked = fill(marked, keys, at, ["_prev"], "forward", span_rows, split)
    marked = fill(marked, keys, at, ["_next"], "backward", span_rows, split)
    x0, y0, m0 = (F.col(f"_prev.{n}") for n in ("_x", "_y", "_m"))
    x1, y1, m1 = (F.col(f"_next.{n}") for n in ("_x", "_y", "_m"))
    h = F.nullif(x1 - x0, F.lit(0)).cast("double")
    t = (F.col("_x") - x0) / h
    if how == "linear":
        inside = y0 + (y1 - y0) * t
    else:
        inside = (y0 * (1 + 2 * t) * (1 - t) * (1 - t) + h * m0 * t * (1 - t) * (1 - t)
                  + y1 * t * t * (3 - 2 * t) + h * m1 * t * t * (t - 1))
    value = F.coalesce(F.col("_y"), inside)
    if edges:
        value = F.coalesce(value, y1, y0)
    if digits is not None:
        value = round_even(value, digits)
    return marked.withColumn(col, value).select(*df.columns)


def _pchip_slopes(knots: DataFrame, keys, span_rows, split) -> DataFrame:
    """Slope at every known point from its two neighbours on either side."""
    def near(w):
        out = {}
        for i in (1, 2):
            out |= {f"_xp{i}": F.lag("_x", i).over(w), f"_yp{i}": F.lag("_y", i).over(w),
                    f"_xn{i}": F.lead("_x", i).over(w), f"_yn{i}": F.lead("_y", i).over(w)}
        return out

    wide = over_rows(knots, keys, [F.col("_x")], near, 2, 2, span_rows, split)
    x, y = F.col("_x"), F.col("_y")
    ha, hb = (x - F.col("_xp1")).cast("double"), (F.col("_xn1") - x).cast("double")
    da, db = (y - F.col("_yp1")) / ha, (F.col("_yn1") - y) / hb
    wa, wb = 2 * hb + ha, hb + 2 * ha
    middle = F.when(da * db <= 0, 0.0).otherwise((wa + wb) / (wa / F.nullif(da, F.lit(0.0)) + wb / F.nullif(db, F.lit(0.0))))

    def end(h0, d0, h1, d1):
        raw = ((2 * h0 + h1) * d0 - h0 * d1) / (h0 + h1)
        return (F.when(F.signum(raw) != F.signum(d0), 0.0)
                .when((F.signum(d0) != F.signum(d1)) & (F.abs(raw) > 3 * F.abs(d0)), 3 * d0).otherwise(raw))

    hn2 = (F.col("_xn2") - F.col("_xn1")).cast("double")
    hp2 = (F.col("_xp1") - F.col("_xp2")).cast("double")
    first = F.when(hn2.isNull(), db).otherwise(end(hb, db, hn2, (F.col("_yn2") - F.col("_yn1")) / hn2))
    last = F.when(hp2.isNull(), da).otherwise(end(ha, da, hp2, (F.col("_yp1") - F.col("_yp2")) / hp2))
    slope = (F.when(ha.isNull() & hb.isNull(), 0.0).when(ha.isNull(), first).when(hb.isNull(), last).otherwise(middle))
    return wide.select(*keys, "_x", "_y", slope.alias("_m"))


def eliminated(lower, diag, upper, rhs) -> tuple[list[float], list[float], list[float]]:
    """A stretch of a tridiagonal system solved for its unknowns as p + q L + r R, where L and R are the
    unknowns before and after the stretch."""
    n = len(diag)
    d, p, q, r = [float(v) for v in diag], [float(v) for v in rhs], [0.0] * n, [0.0] * n
    q[0], r[-1] = -float(lower[0]), -float(upper[-1])
    for i in range(1, n):
        f = lower[i] / d[i - 1]
        d[i] -= f * upper[i - 1]
        p[i] -= f * p[i - 1]
        q[i] -= f * q[i - 1]
    for i in range(n - 1, -1, -1):
        if i < n - 1:
            p[i] -= upper[i] * p[i + 1]
            q[i] -= upper[i] * q[i + 1]
            r[i] -= upper[i] * r[i + 1]
        p[i], q[i], r[i] = p[i] / d[i], q[i] / d[i], r[i] / d[i]
    return p, q, r


def chained(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unknowns before and after each stretch, from (p, q, r) of the first and last place of each in a row."""
    n = len(first)
    a, b, alpha, beta = np.zeros((4, n))                     # first place: a + b R; last place: alpha + beta R
    for j in range(n):
        before, slope = (alpha[j - 1], beta[j - 1]) if j else (0.0, 0.0)
        p, q, r = first[j]
        a[j], b[j] = (p + q * before) / (1 - q * slope), r / (1 - q * slope)
        p, q, r = last[j]
        alpha[j], beta[j] = p + q * (before + slope * a[j]), q * slope * b[j] + r
    left, right = np.zeros(n), np.zeros(n)
    for j in range(n - 1, -1, -1):
        right[j] = a[j + 1] + b[j + 1] * right[j + 1] if j < n - 1 else 0.0
    left[1:] = (alpha + beta * right)[:-1]
    return left, right


def _spline(df, keys, order, col, digits, span_rows, split) -> DataFrame:
    """Interpolating cubic spline whose end pieces follow the cubic through the four end points; fewer than four
    points give the polynomial through them.

    The second derivatives solve a tridiagonal system. It is cut into stretches of ``span_rows`` points: each
    is solved in terms of the unknowns before and after it, the stretches' ends make a system of
    their own with one row per stretch, and its solution is put back. A series may have any length.
    """
    split = needs_split(df, keys, span_rows) if split is None else split
    placed = with_position(df, order, keys, "_x", span_rows, split).withColumn("_y", F.col(col).cast("double"))
    knots = placed.filter("_y IS NOT NULL").select(*keys, "_x", "_y")
    knots = null_safe_join(knots, knots.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")), keys)
    knots = with_position(knots, [F.col("_x")], keys, "_k", span_rows, split)
    steps = [i for i in range(-3, 4) if i]
    wide = over_rows(knots, keys, [F.col("_x")], lambda w: {
        f"_{c}{i}": (F.lag(f"_{c}", -i) if i < 0 else F.lead(f"_{c}", i)).over(w) for c in "xy" for i in steps}, 3, 3, span_rows, split)

    def gap(i):                                              # from point i to the next, counted from this row
        x = lambda j: F.col(f"_x{j}" if j else "_x")                                        # noqa: E731
        return (x(i + 1) - x(i)).cast("double")

    def divided(i, size):                                    # divided difference of ``size`` + 1 points from point i on
        if size == 0:
            return F.col(f"_y{i}" if i else "_y")
        return (divided(i + 1, size - 1) - divided(i, size - 1)) / reduce(lambda a, b: a + b, [gap(i + j) for j in range(size)])

    first, last, few, zero = F.col("_k") == 1, F.col("_k") == F.col("_n"), F.col("_n") < 4, F.lit(0.0)
    bend = F.when(F.col("_n") < 3, 0.0).when(first, divided(0, 2)).when(last, divided(-2, 2)).otherwise(divided(-1, 2)) / 3.0
    rows = wide.select(
        *keys, "_x", "_y", "_k", "_n", F.coalesce(gap(0), gap(-1), F.lit(1.0)).alias("_h"), F.coalesce(divided(0, 1), divided(-1, 1), zero).alias("_slope"),
        F.when(few | first, 0.0).otherwise(gap(-1)).alias("_lower"), F.when(few | last, 0.0).otherwise(gap(0)).alias("_upper"),
        F.when(few, 1.0).when(first, -gap(0)).when(last, -gap(-1)).otherwise(2.0 * (gap(-1) + gap(0))).alias("_diag"),
        F.when(few, bend).when(first, gap(0) * gap(0) * divided(0, 3)).when(last, -gap(-1) * gap(-1) * divided(-3, 3))
        .otherwise(divided(0, 1) - divided(-1, 1)).alias("_rhs"),
        F.floor((F.col("_k") - 1) / span_rows).cast("bigint").alias("_block"))
    system = ["_lower", "_diag", "_upper", "_rhs"]
    passed = [c for c in rows.columns if c not in system]

    def solve(part: pa.Table) -> pa.Table:
        part = part.sort_by("_k")
        found = eliminated(*(part.column(c).to_numpy() for c in system))
        return pa.Table.from_arrays([*(part.column(c) for c in passed), *(pa.array(v, pa.float64()) for v in found)], [*passed, "_p", "_q", "_r"])

    schema = rows.select(*passed, *[zero.alias(c) for c in ("_p", "_q", "_r")]).schema
    parts = checkpointed(rows.groupBy(*keys, "_block").applyInArrow(solve, schema))
    ends = parts.groupBy(*keys, "_block").agg(*[pick(F.struct("_p", "_q", "_r"), "_k").alias(c) for c, pick in (("_first", F.min_by), ("_last", F.max_by))])

    def chain(part: pa.Table) -> pa.Table:                   # one row per stretch of a series
        part = part.sort_by("_block")
        sides = [np.array([[v["_p"], v["_q"], v["_r"]] for v in part.column(c).to_pylist()]) for c in ("_first", "_last")]
        return pa.Table.from_arrays([*(part.column(k) for k in [*keys, "_block"]), *(pa.array(v) for v in chained(*sides))], [*keys, "_block", "_left", "_right"])

    sides = ends.groupBy(*keys).applyInArrow(chain, ends.select(*keys, "_block", zero.alias("_left"), zero.alias("_right")).schema) if keys else (
        ends.groupBy(F.lit(0)).applyInArrow(chain, ends.select("_block", zero.alias("_left"), zero.alias("_right")).schema))
    bent = null_safe_join(parts, sides, [*keys, "_block"]).withColumn("_s", F.col("_p") + F.col("_q") * F.col("_left") + F.col("_r") * F.col("_right"))
    around = over_rows(bent.select(*keys, "_x", "_y", "_n", "_k", "_h", "_slope", "_s"), keys, [F.col("_x")], lambda w: {
        "_s1": F.lead("_s").over(w), "_x_": F.lag("_x").over(w), "_y_": F.lag("_y").over(w), "_s_": F.lag("_s").over(w)}, 1, 1, span_rows, split)
    # A knot carries the piece that begins there; the last one that which ends there.
    ends_here = last & (F.col("_n") > 1)
    one = lambda here, before: F.when(ends_here, F.col(before)).otherwise(F.col(here))       # noqa: E731
    piece = F.struct(one("_x", "_x_").alias("x"), one("_y", "_y_").alias("y"), one("_s", "_s_").alias("s"),
                     F.when(ends_here, F.col("_s")).otherwise(F.coalesce("_s1", "_s")).alias("e"), F.col("_h").alias("h"), F.col("_slope").alias("m"))
    marked = null_safe_join(placed, around.select(*keys, "_x", piece.alias("_prev")), [*keys, "_x"]).withColumn("_next", F.col("_prev"))
    marked = fill(marked, keys, [F.col("_x")], ["_prev"], "forward", span_rows, split)
    marked = fill(marked, keys, [F.col("_x")], ["_next"], "backward", span_rows, split)
    at = F.coalesce("_prev", "_next")
    t = F.col("_x") - at["x"]
    value = at["y"] + t * (at["m"] - at["h"] * (2 * at["s"] + at["e"]) + t * (3 * at["s"] + t * (at["e"] - at["s"]) / at["h"]))
    value = F.coalesce(F.col("_y"), value)
    return marked.withColumn(col, value if digits is None else round_even(value, digits)).select(*df.columns)


def impute_by_model(df: DataFrame, key: str, target: str, estimator) -> DataFrame:
    """Fit on the rows that have the target, predict the rows that do not."""
    model = estimator.fit(df.filter(F.col(target).isNotNull()).withColumn("label", F.col(target).cast("double")))
    pred = model.transform(df.filter(F.col(target).isNull())).select(key, "prediction")
    return joins.backfill(df, pred, key, target)


def chained_impute(df: DataFrame, key: str, cols, m: int = 1, iters: int = 3, seed: int = 0, span_rows: int = SPAN_ROWS) -> DataFrame:
    """Multiple imputation by chained equations with predictive mean matching.

    Each column in turn is regressed on the others, and coefficients are drawn from their posterior. A missing
    value takes the observed value of the row whose fitted value is nearest to the value that the drawn
    coefficients predict. Donors are found by one sort on the predictions, the nearer of the next lower
    and the next higher one (a hash of the key decides between equals), so no pairs of rows are formed.
    Returns one completed table per imputation, with its number.
    """
    from tabkit.operators.stats import ols

    cols = list(cols)
    gaps = [r["column"] for r in _na_columns(df, cols)]
    flagged = checkpointed(df.withColumns({f"_na_{c}": F.col(c).isNull() for c in gaps}))
    out = []
    for i in range(m):
        done = impute(flagged.withColumns({c: F.col(c).cast("double") for c in cols}), cols, "mean")
        for step in range(iters):
            for at, c in enumerate(gaps):
                others = [o for o in cols if o != c]
                fit = ols(done.filter(~F.col(f"_na_{c}")), c, others)
                drawn = posterior_draw(fit, np.random.default_rng([seed, i, step, at]))
                scored = done.withColumn("_p", F.when(F.col(f"_na_{c}"), drawn.predict()).otherwise(fit.predict()))
                done = checkpointed(_match_donors(scored, key, c, seed + 1000 * i + step, span_rows).drop("_p"))
        out.append(done.select(F.lit(i + 1).alias("imputation"), *df.columns))
    return reduce(DataFrame.unionByName, out)


def posterior_draw(fit, rng: np.random.Generator):
    """The fit with coefficients drawn from their posterior under a flat prior: the variance from its scaled
    inverse chi-squared, the coefficients around their estimates by the Cholesky factor of their covariance."""
    sigma = np.sqrt(fit.sse / rng.chisquare(fit.n - len(fit.x) - 1))
    slopes = fit.beta[1:]
    centred = np.concatenate([[fit.beta[0] + slopes @ fit.means], slopes])
    drawn = centred + sigma * np.linalg.cholesky(fit.xtx_inv) @ rng.standard_normal(len(centred))
    return replace(fit, beta=np.concatenate([[drawn[0] - drawn[1:] @ fit.means], drawn[1:]]))


def _na_columns(df, cols):
    from tabkit.operators.agg import na_share

    return na_share(df.select(*cols)).filter("na_count > 0").orderBy("column").collect()


def _match_donors(scored: DataFrame, key: str, col: str, seed: int, span_rows: int) -> DataFrame:
    missing = F.col(f"_na_{col}")
    placed = with_position(scored, ["_p", key], name="_at", span_rows=span_rows)
    placed = placed.withColumns({
        "_low": F.when(~missing, F.struct("_p", col)), "_high": F.when(~missing, F.struct("_p", col))})
    placed = placed.withColumn("_all", F.lit(0))
    placed = fill(placed, ["_all"], ["_at"], ["_low"], "forward", span_rows)
    placed = fill(placed, ["_all"], ["_at"], ["_high"], "backward", span_rows)
    below, above = F.col("_p") - F.col("_low._p"), F.col("_high._p") - F.col("_p")
    lower = F.when(below == above, F.substring(hash_text(F.col(key), seed=seed), 1, 1) < "8").otherwise(below < above)
    donor = F.when(F.col("_high").isNull() | lower, F.col("_low")).otherwise(F.col("_high"))
    return placed.withColumn(col, F.when(missing, donor[col]).otherwise(F.col(col))).drop("_at", "_low", "_high", "_all")
