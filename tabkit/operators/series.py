"""Holiday calendars, daily panels and forecasts of many series."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabkit.functions.scalars import recode, round_even
from tabkit.operators.agg import corr_by, distinct_on
from tabkit.operators.encode import label_encoder
from tabkit.operators.forecast import additive, arx
from tabkit.operators.joins import enrich, join_coalesce
from tabkit.operators.order import null_safe_join, with_position
from tabkit.operators.windows import add_lags
from tabkit.sources.workspace import checkpointed


def clean_holidays(df: DataFrame, kind: str = "type", transferred: str = "transferred") -> DataFrame:
    """Bridge and Transfer days become Additional; transferred and working days go."""
    moved = F.coalesce(F.col(transferred), F.lit(False))
    return (df.withColumn(kind, recode(F.col(kind), {"Bridge": "Additional", "Transfer": "Additional"}))
            .filter(~(moved | (F.coalesce(F.col(kind), F.lit("")) == "Work Day"))).drop(transferred))


def holiday_calendar(days: DataFrame, holidays: DataFrame, order, date: str = "date", cols=("day_type", "locale")) -> DataFrame:
    """Day types overlaid with the first holiday of each date, in the given order."""
    first = distinct_on(holidays, [date], order)
    return join_coalesce(days, first, date, list(cols))


def holiday_regressors(df: DataFrame, kind: str = "type", transferred: str = "transferred", date: str = "date",
                       place: str = "locale_name") -> DataFrame:
    """Distinct (date, place) of holidays that were not moved."""
    return df.filter((F.col(kind) == "Holiday") & ~F.col(transferred)).select(date, place).distinct()


def build_panel(facts: DataFrame, dims, date: str) -> DataFrame:
    """Facts joined with all their dimensions, with weekday and month columns."""
    from tabkit.operators.encode import calendar_features

    return calendar_features(enrich(facts, dims), date)


def lag_features(df: DataFrame, keys, order, col: str, lags, tag: str = "data_type", train: str = "train",
                 split: bool | None = None) -> DataFrame:
    """Lags over train and test rows together; training rows without all lags are dropped."""
    out = add_lags(df, keys, order, col, lags, split=split)
    names = [f"{col}_lag_{k}" for k in lags]
    full = F.lit(True)
    for c in names:
        full = full & F.col(c).isNotNull()
    return out.filter((F.col(tag) != train) | full)


def group_correlations(df: DataFrame, keys, x: str, y: str) -> DataFrame:
    """Correlation per group, strongest first."""
    return corr_by(df, x, y, keys).orderBy(F.desc("corr"))


def seasonal_naive(train: DataFrame, test: DataFrame, keys, date: str, y: str, season: int = 7) -> DataFrame:
    """Each test row gets the value of the same phase in the last season of the training rows."""
    keys = list(keys)
    tail = with_position(train, [F.desc(date)], keys, "_back").filter(F.col("_back") <= season).select(
        *keys, (season - F.col("_back")).alias("_slot"), F.col(y).alias("prediction"))
    ahead = with_position(test, [date], keys, "_step").withColumn("_slot", (F.col("_step") - 1) % season)
    return null_safe_join(ahead, tail, [*keys, "_slot"]).drop("_slot", "_step")


def forecast_groups(train: DataFrame, test: DataFrame, keys, date: str, y: str, regressors=(), method: str = "arx",
                    log: bool = True, season: int = 7, categories=(), **options) -> DataFrame:
    """Forecast every series of a panel (one row per key and date) over its test rows; adds ``prediction``.

    ``log`` fits log1p of the target and inverts it. ``categories`` are regressors that stand for the place
    of their level in sorted order. Methods: 'arx', 'additive' (both in ``operators/forecast.py``, with their
    options) and 'seasonal_naive', which repeats the last ``season`` rows.
    """
    keys, regressors, categories = list(keys), list(regressors), list(categories)
    if method not in ("arx", "additive", "seasonal_naive"):
        raise ValueError(f"unknown method {method!r}")
    if method == "seasonal_naive":
        return seasonal_naive(train, test, keys, date, y, season)
    # Both panels are read several times below, so they are computed once.
    known, test, names = checkpointed(train.filter(F.col(y).isNotNull())), checkpointed(test), test.columns
    for side in (known, test):
        if not side.groupBy(*keys, date).agg(F.count(F.lit(1)).alias("_c")).filter("_c > 1").isEmpty():
            raise ValueError("a panel has one row per key and date; aggregate it first")
    for c in categories:
        codes = label_encoder(known.select(c).unionByName(test.select(c)), c, f"_code_{c}")
        known, test = codes.apply(known), codes.apply(test)
        regressors.append(f"_code_{c}")
    cols = [*keys, date, *[F.col(c).cast("double").alias(c) for c in regressors]]
    value = F.log1p(F.col(y).cast("double")) if log else F.col(y).cast("double")
    solve = arx if method == "arx" else additive
    got = solve(known.select(*cols, value.alias(y)), test.select(*cols), keys, date, y, regressors, **options)
    got = got.withColumn("prediction", F.expm1("prediction") if log else F.col("prediction"))
    return null_safe_join(test, got, [*keys, date]).select(*names, "prediction")


def finish_forecast(pred: DataFrame, id_cols, out: str, digits: int = 3, inverse: str | None = None) -> DataFrame:
    """Back to the original scale, rounded half to even, NULL and negative values to zero."""
    value = F.expm1("prediction") if inverse == "expm1" else F.col("prediction")
    return pred.select(*id_cols, F.greatest(F.lit(0.0), F.coalesce(round_even(value, digits), F.lit(0.0))).alias(out))
