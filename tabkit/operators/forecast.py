"""Forecasts of many series by least squares on cross products.

Rows never leave Spark: lags are windows, products are summed per series map-side, and predictions are
expressions over the fitted coefficients. Between the two, each series is one small matrix, and a block
of them is solved at a time. A series may have any length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StructField, StructType

from tabkit.operators.moments import Elimination, as_stack, list_column, product_sums, solve_stack, symmetric, vector_sums
from tabkit.operators.order import SPAN_ROWS, needs_split, null_safe_join, over_rows

_CELLS = 4 << 20
_NUMBERS = ArrayType(DoubleType())


def _keyed(df: DataFrame, keys, **columns) -> StructType:
    return StructType([df.schema[k] for k in keys] + [StructField(n, t) for n, t in columns.items()])


def _stacks(batches: Iterator[pa.RecordBatch], cells: int) -> Iterator[pa.RecordBatch]:
    """Batches of so many series that their matrices of ``cells`` numbers fill no more than a block."""
    step = max(1, _CELLS // max(cells, 1))
    for batch in batches:
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)


def _fill_means(df: DataFrame, names) -> DataFrame:
    """Values less the mean of their series; missing ones are at the mean."""
    return df.withColumns({c: F.coalesce(F.col(c) - F.col(f"_mean_{c}"), F.lit(0.0)) for c in names})


def arx(train: DataFrame, test: DataFrame, keys, date: str, y: str, regressors=(), max_order: int = 7,
        span_rows: int = SPAN_ROWS) -> DataFrame:
    """Autoregression with regressors per series, and its forecasts step by step, fed back as lags.

    All orders up to ``max_order``, and up to a third of the series' rows, share the rows that have all
    those lags; lags enter the normal equations one after another, and the order with the least AIC stays.
    Training rows without a regressor only serve as lags. A series of fewer than eight rows, a constant one,
    and one with too few complete rows repeat their mean. A forecast row without a regressor takes the
    regressor's mean. A series' forecast rows are one array: its horizon is a number of steps that depend
    on each other. Returns keys, date, prediction; series without training rows get NULL.
    """
    keys, regressors, top = list(keys), list(regressors), max_order
    p, size = len(regressors), 2 + len(regressors) + max_order
    stats = train.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.avg(y).alias("_mean"),
                                     *[F.avg(c).alias(f"_mean_{c}") for c in regressors])
    stats = stats.withColumn("_top", F.least(F.lit(top), F.floor(F.col("_n") / 3)).cast("int"))
    split = needs_split(train, keys, span_rows)
    rows = null_safe_join(train.select(*keys, date, y, *regressors), stats, keys)
    full = F.lit(True)
    for c in regressors:
        full = full & F.col(c).isNotNull()
    rows = _fill_means(rows.withColumns({"_full": full, "_v": F.col(y) - F.col("_mean")}), regressors)
    lagged = over_rows(rows, keys, [date], lambda w: {
        "_lags": F.array(*[F.lag("_v", k).over(w) for k in range(1, top + 1)]).cast(_NUMBERS), "_ahead": F.lead("_v", max(top, 1)).over(w)},
        before=top, after=max(top, 1), span_rows=span_rows, split=split)
    usable = F.col("_full") & ((F.col("_top") < 1) | F.get("_lags", F.col("_top") - 1).isNotNull())
    z = F.concat(F.array(F.lit(1.0), *[F.col(c) for c in regressors]).cast(_NUMBERS),
                 F.transform("_lags", lambda x: F.coalesce(x, F.lit(0.0))), F.array("_v"))
    sums = product_sums(lagged.filter(usable).select(*keys, z.alias("_z")), keys, "_z", size, "_sums")
    tails = lagged.filter("_ahead IS NULL").groupBy(*keys).agg(F.transform(
        F.sort_array(F.collect_list(F.struct(F.col(date).alias("at"), F.col("_v").alias("v"))), asc=False), lambda x: x["v"]).alias("_past"))

    def fit(batches):
        for batch in _stacks(batches, size * size):
            moments = symmetric(as_stack(batch.column("_sums"), size * (size + 1) // 2), size)
            n, limit = moments[:, 0, 0], batch.column("_top").to_numpy()
            steps = Elimination(moments)
            for k in range(1 + p):
                steps.take(k)
            best, chosen = np.full(len(n), np.inf), np.zeros((len(n), size - 1))
            for order in range(top + 1):
                if order:
                    steps.take(p + order)
                columns = steps.taken.sum(1)
                aic = n * np.log(np.maximum(steps.residual, 1e-12) / n) + 2 * columns
                better = (order <= limit) & (n > 2 + p + order) & (aic < best)
                best = np.where(better, aic, best)
                chosen[better] = steps.coefficients[better]
            still = (batch.column("_n").to_numpy() < 8) | (moments[:, -1, -1] <= 1e-18 * n)
            chosen[still] = 0.0
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keys), list_column(chosen)], [*keys, "_beta"])

    beta = null_safe_join(sums, stats.select(*keys, "_n", "_top"), keys).mapInArrow(fit, _keyed(sums, keys, _beta=_NUMBERS))
    fitted = null_safe_join(null_safe_join(stats, beta, keys), tails, keys)

    ahead = null_safe_join(test.select(*keys, date, *regressors), stats.drop("_n", "_top"), keys)
    ahead = _fill_means(ahead, regressors).groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(
        F.col(date).alias("at"), F.array(F.lit(1.0), *[F.col(c) for c in regressors]).cast(_NUMBERS).alias("x")))).alias("_steps"))
    both = null_safe_join(ahead, fitted, keys)
    nothing = F.array().cast(_NUMBERS)
    beta = F.coalesce("_beta", F.array_repeat(F.lit(0.0), size - 1))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda u, v: F.coalesce(u * v, F.lit(0.0))), F.lit(0.0), lambda s, x: s + x)     # noqa: E731

    def step(acc, s):
        value = dot(s["x"], F.slice(F.col("_b"), 1, 1 + p)) + dot(acc["past"], F.slice(F.col("_b"), 2 + p, top) if top else nothing)
        return F.struct(F.slice(F.concat(F.array(value), acc["past"]), 1, max(top, 1)).alias("past"), F.concat(acc["out"], F.array(value)).alias("out"))

    start = F.struct(F.coalesce(F.slice("_past", 1, max(top, 1)), nothing).alias("past"), nothing.alias("out"))
    run = both.withColumn("_b", beta).withColumn("_out", F.aggregate("_steps", start, step, lambda acc: acc["out"]))
    zipped = F.explode(F.arrays_zip(F.col("_steps.at").alias("at"), F.col("_out").alias("value"))).alias("_s")
    return run.select(*keys, "_mean", zipped).select(
        *keys, F.col("_s.at").alias(date), (F.col("_s.value") + F.col("_mean")).alias("prediction"))


def holiday_effects(holidays: DataFrame, date: str = "date", name: str = "holiday", lower: str | None = None,
                    upper: str | None = None) -> DataFrame:
    """One row per date with the effects that hold on it: a holiday's name and the days since it.

    ``lower`` (negative or zero) and ``upper`` name columns with the window of days around a holiday; each
    day of it is an effect of its own. NULL stands for zero. Columns: date, effects.
    """
    low = F.coalesce(F.col(lower), F.lit(0)).cast("int") if lower else F.lit(0)
    high = F.coalesce(F.col(upper), F.lit(0)).cast("int") if upper else F.lit(0)
    days = holidays.filter(F.col(date).isNotNull() & F.col(name).isNotNull()).select(
        F.col(date).alias("_on"), F.col(name).cast("string").alias("_name"), F.explode(F.sequence(F.least(low, F.lit(0)), F.greatest(high, F.lit(0)))).alias("_shift"))
    effect = F.when(F.col("_shift") == 0, F.col("_name")).otherwise(F.concat_ws("_", "_name", F.format_string("%+d", "_shift")))
    return days.groupBy(F.date_add("_on", F.col("_shift")).alias(date)).agg(F.array_sort(F.collect_set(effect)).alias("effects"))


def _seasons(day: Column, weekly: int, yearly: int) -> list[Column]:
    waves = []
    for period, n in ((7.0, weekly), (365.25, yearly)):
        for k in range(1, n + 1):
            angle = day * F.lit(2 * np.pi * k / period)
            waves += [F.sin(angle), F.cos(angle)]
    return waves


def additive(train: DataFrame, test: DataFrame, keys, date: str, y: str, regressors=(), effects: DataFrame | None = None,
             weekly: int = 3, yearly: int = 10, ridge: float = 1.0, trend: bool = True) -> DataFrame:
    """Linear trend, weekly and yearly Fourier terms, holiday effects and regressors per series by ridge least squares.

    ``effects`` has a date and an array of effect names (see ``holiday_effects``). Effects are sparse: a
    series' dense columns are summed once over all rows and once over the rows of each effect, and the
    effects are eliminated from the normal equations first (their Schur complement). The ridge is on the scale of
    standardised regressors and leaves the intercept alone. A series of less than two years has no yearly
    terms; one of fewer than four rows repeats its mean. Training rows without a regressor are left out; a
    forecast row without one takes its mean. An effect that the training rows never show adds nothing.
    Returns keys, date, prediction; series without training rows get NULL.
    """
    keys, regressors = list(keys), list(regressors)
    waves, p = 2 * (weekly + yearly), len(regressors)
    size = 3 + waves + p                                                 # intercept, trend, waves, regressors, response
    day = F.datediff(F.col(date), F.lit("1970-01-01").cast("date")).cast("double")
    full = F.lit(True)
    for c in regressors:
        full = full & F.col(c).isNotNull()
    known, marked = train.filter(full), effects is not None
    stats = train.groupBy(*keys).agg(F.avg(y).alias("_mean"), F.min(day).alias("_first"), F.max(day).alias("_last"),
                                     *[F.avg(c).alias(f"_mean_{c}") for c in regressors])
    span = F.greatest(F.col("_last") - F.col("_first"), F.lit(1.0))

    def design(df: DataFrame) -> DataFrame:
        # Days count from one fixed date, so that phases agree between series; the trend runs from 0 to 1.
        cols = [F.lit(1.0), (day - F.col("_first")) / span, *_seasons(day, weekly, yearly), *[F.col(c) for c in regressors]]
        out = null_safe_join(df.select(*keys, date, *([y] if y in df.columns else []), *regressors), stats, keys)
        if marked:
            out = null_safe_join(out, effects.select(date, F.col("effects").alias("_effects")), [date])
        return _fill_means(out, regressors).withColumn("_x", F.array(*cols).cast(_NUMBERS))

    rows = design(known).withColumn("_z", F.concat("_x", F.array(F.col(y) - F.col("_mean"))))
    sums = null_safe_join(product_sums(rows, keys, "_z", size, "_sums"), stats.select(*keys, (F.col("_last") - F.col("_first")).alias("_span")), keys)
    if marked:
        shown = rows.filter(F.size("_effects") > 0).select(*keys, "_z", "_effects", F.explode("_effects").alias("_effect"))
        each = vector_sums(shown, [*keys, "_effect"], F.col("_z"), "_with")
        meet = shown.select(*keys, "_effect", F.explode("_effects").alias("_other")).groupBy(*keys, "_effect", "_other").agg(
            F.count(F.lit(1)).cast("double").alias("_both"))
        meet = meet.groupBy(*keys, "_effect").agg(F.collect_list(F.struct("_other", "_both")).alias("_met"))
        sparse = null_safe_join(each, meet, [*keys, "_effect"]).groupBy(*keys).agg(
            F.collect_list(F.struct(F.col("_effect").alias("effect"), F.col("_with").alias("sums"), F.col("_met").alias("met"))).alias("_sparse"))
        sums = null_safe_join(sums, sparse, keys)
    named = ArrayType(StructType([StructField("effect", sums.schema["_sparse"].dataType.elementType["effect"].dataType),
                                  StructField("value", DoubleType())])) if marked else ArrayType(IntegerType())

    def fit(batches):
        for batch in _stacks(batches, size * size):
            moments = symmetric(as_stack(batch.column("_sums"), size * (size + 1) // 2), size)
            n, b = moments[:, 0, 0], len(moments)
            penalty = np.full((b, size - 1), float(ridge))
            penalty[:, 0] = 0.0
            spread = np.diagonal(moments, axis1=1, axis2=2)[:, 2 + waves:-1] / n[:, None] - (moments[:, 0, 2 + waves:-1] / n[:, None]) ** 2
            penalty[:, 2 + waves:] *= np.where(spread > 0, spread, 1.0)
            off = np.zeros((b, size - 1), bool)
            off[:, 2 + 2 * weekly:2 + waves] = (batch.column("_span").to_numpy() < 2 * 365.25)[:, None]
            off[:, 1] = not trend
            off[n < 4, 1:] = True
            a, rhs = moments[:, :-1, :-1].copy(), moments[:, :-1, -1].copy()
            if marked:
                names, cross, own, met = _sparse_blocks(batch.column("_sparse"), size, ridge)
                met[n < 4] = np.eye(len(names))
                cross[n < 4], own[n < 4] = 0.0, 0.0
                cross = np.where(off[:, None, :], 0.0, cross)
                inner = solve_stack(met, np.concatenate([cross, own[:, :, None]], 2)) if len(names) else np.zeros((b, 0, size))
                a -= np.swapaxes(cross, 1, 2) @ inner[:, :, :-1]
                rhs -= (np.swapaxes(cross, 1, 2) @ inner[:, :, -1:])[:, :, 0]
            a[off[:, :, None] | off[:, None, :]] = 0.0
            rhs[off] = 0.0
            at = np.arange(size - 1)
            a[:, at, at] += np.where(off, 1.0, penalty)
            beta = solve_stack(a, rhs[:, :, None])
            arrays, columns = [*(batch.column(k) for k in keys), list_column(beta[:, :, 0])], [*keys, "_beta"]
            if marked:
                gamma = inner[:, :, -1] - (inner[:, :, :-1] @ beta)[:, :, 0]
                seen = gamma != 0
                row, code = np.nonzero(seen)
                ends = np.concatenate([[0], np.cumsum(seen.sum(1))]).astype(np.int32)
                pairs = pa.StructArray.from_arrays([names.take(pa.array(code)), pa.array(gamma[row, code])], ["effect", "value"])
                arrays.append(pa.ListArray.from_arrays(pa.array(ends), pairs))
                columns.append("_gamma")
            yield pa.RecordBatch.from_arrays(arrays, columns)

    shape = dict(_beta=_NUMBERS) | (dict(_gamma=named) if marked else {})
    beta = sums.mapInArrow(fit, _keyed(sums, keys, **shape))
    out = null_safe_join(design(test), beta, keys)
    value = F.col("_mean") + F.aggregate(F.zip_with("_x", "_beta", lambda u, v: u * v), F.lit(0.0), lambda s, x: s + x)
    if marked:
        here = F.filter("_gamma", lambda g: F.array_contains(F.coalesce("_effects", F.array().cast("array<string>")), g["effect"]))
        value = value + F.coalesce(F.aggregate(here, F.lit(0.0), lambda s, g: s + g["value"]), F.lit(0.0))
    return out.select(*keys, date, F.coalesce(value, F.col("_mean")).alias("prediction"))


def _sparse_blocks(column: pa.Array, size: int, ridge: float):
    """Names of the effects of a block of series, and per series their sums with the dense columns and the
    response, and with each other plus the ridge. An effect that a series lacks stands alone at one."""
    rows = column.to_pylist()
    names = sorted({e["effect"] for r in rows if r for e in r})
    code = {name: i for i, name in enumerate(names)}
    cross, own = np.zeros((len(rows), len(names), size - 1)), np.zeros((len(rows), len(names)))
    met = np.zeros((len(rows), len(names), len(names)))
    for i, r in enumerate(rows):
        for e in r or []:
            k = code[e["effect"]]
            cross[i, k], own[i, k] = e["sums"][:-1], e["sums"][-1]
            for other in e["met"]:
                met[i, k, code[other["_other"]]] = other["_both"]
            met[i, k, k] += ridge
    at = np.arange(len(names))
    met[:, at, at] = np.where(met[:, at, at] == 0, 1.0, met[:, at, at])
    return pa.array(names, pa.string()), cross, own, met
