"""Statistics, tests, least squares and feature screens."""

from __future__ import annotations

import math
from dataclasses import dataclass
from itertools import combinations_with_replacement

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabkit.functions.numerics import (binomial_interval, binomial_two_sided, f_tail, normal_quantile_sql, t_quantile,
                                       t_two_sided, z_two_sided)
from tabkit.operators.agg import corr_matrix, freq, head_by, one_row_to_long
from tabkit.operators.order import SPAN_ROWS, largest_group, null_safe_join, over_rows, with_position

# Common English words left out of term counts.
STOPWORDS = """
i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself
it its itself they them their theirs themselves what which who whom this that these those am is are was were be
been being have has had having do does did doing would should could ought i'm you're he's she's it's we're they're
i've you've we've they've i'd you'd he'd she'd we'd they'd i'll you'll he'll she'll we'll they'll isn't aren't
wasn't weren't hasn't haven't hadn't doesn't don't didn't won't wouldn't shan't shouldn't can't cannot couldn't
mustn't let's that's who's what's here's there's when's where's why's how's a an the and but if or because as
until while of at by for with about against between into through during before after above below to from up down
in out on off over under again further then once here there when where why how all any both each few more most
other some such no nor not only own same so than too very
""".split()


def binom_test(df: DataFrame, keys, flag: str, p: float = 0.5, level: float = 0.95) -> DataFrame:
    """Exact binomial test of a 0/1 column per group, with its confidence interval.

    The rows are counted by Spark; only the two counts of a group reach the tail functions.
    """
    counts = df.filter(F.col(flag).isNotNull()).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col(flag).cast("bigint")).alias("hits"))

    @F.pandas_udf("p_value double, low double, high double")
    def tails(n: pd.Series, hits: pd.Series) -> pd.DataFrame:
        rows = [(binomial_two_sided(int(x), int(m), p), *binomial_interval(int(x), int(m), level)) for x, m in zip(hits, n)]
        return pd.DataFrame(rows, columns=["p_value", "low", "high"])

    return counts.withColumn("_t", tails("n", "hits")).select(
        *keys, "n", "hits", (F.col("hits") / F.col("n")).alias("rate"), "_t.*")


def moments(df: DataFrame, cols) -> DataFrame:
    """Count, mean, population variance, skewness and excess kurtosis per column, in one aggregate.
    A constant column has no skewness or kurtosis."""
    row = df.agg(*[e for c in cols for e in (
        F.count(c).alias(f"{c}|n"), F.avg(c).alias(f"{c}|mean"), F.var_pop(c).alias(f"{c}|var"),
        F.skewness(c).alias(f"{c}|skew"), F.kurtosis(c).alias(f"{c}|kurt"))])
    return one_row_to_long(row, cols, {"n": "bigint", "mean": "double", "var": "double", "skew": "double", "kurt": "double"})


def jarque_bera(df: DataFrame, cols) -> DataFrame:
    """Normality by moments: statistic and p-value per column."""
    jb = F.col("n") / 6.0 * (F.pow("skew", F.lit(2.0)) + F.pow("kurt", F.lit(2.0)) / 4.0)
    return moments(df, cols).select("column", "n", jb.alias("jb"), F.exp(-jb / 2.0).alias("p_value"))


def normality(df: DataFrame, cols, level: float = 0.05) -> DataFrame:
    """Columns whose normality is rejected."""
    return jarque_bera(df, cols).filter(F.col("p_value") < level)


def shapiro_francia(df: DataFrame, col: str, keys=(), span_rows: int = SPAN_ROWS) -> DataFrame:
    """Squared correlation of the ordered values with normal scores (equal values take
    neighbouring ranks)."""
    data = df.filter(F.col(col).isNotNull()).select(*keys, F.col(col).cast("double").alias("_v"))
    sizes = data.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    ranked = null_safe_join(with_position(data, ["_v"], keys, "_i", span_rows), sizes, list(keys))
    p = "((CAST(_i AS DOUBLE)-0.375E0)/(CAST(_n AS DOUBLE)+0.25E0))"
    scored = ranked.withColumn("_s", F.expr(normal_quantile_sql(p)))
    return scored.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.pow(F.corr("_v", "_s"), F.lit(2.0)).alias("w"))


def anova(df: DataFrame, factors, y: str) -> DataFrame:
    """One-way F test of y for every factor, NULL levels left out.

    All factors share one pass: rows become (factor, level, y) triples that are summed
    map-side. Sums are of y less the overall mean, so they do not lose digits.
    """
    mean = df.agg(F.avg(y)).first()[0] or 0.0
    long = df.filter(F.col(y).isNotNull()).select(F.explode(F.array(*[
        F.struct(F.lit(f).alias("factor"), F.col(f).cast("string").alias("level"),
                 (F.col(y) - F.lit(mean)).alias("y")) for f in factors])).alias("_x")).select("_x.*")
    levels = long.filter("level IS NOT NULL").groupBy("factor", "level").agg(
        F.count(F.lit(1)).alias("n"), F.avg("y").alias("m"), F.var_pop("y").alias("v"))
    sums = levels.groupBy("factor").agg(
        F.count(F.lit(1)).alias("k"), F.sum("n").alias("n"), F.sum(F.col("n") * F.col("v")).alias("ssw"),
        F.sum(F.col("n") * F.col("m")).alias("sy"), F.sum(F.col("n") * F.col("m") * F.col("m")).alias("sm2"))
    d1, d2 = F.col("k") - 1, F.col("n") - F.col("k")
    ssb = F.col("sm2") - F.col("sy") * F.col("sy") / F.col("n")
    stat = (ssb / F.nullif(d1, F.lit(0))) / F.nullif(F.col("ssw") / F.nullif(d2, F.lit(0)), F.lit(0.0))

    @F.pandas_udf("double")
    def tail(f: pd.Series, a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([f_tail(float(x), float(p), float(q)) if pd.notna(x) else np.nan for x, p, q in zip(f, a, b)])

    return sums.select("factor", d1.alias("df1"), d2.alias("df2"), stat.alias("f")).withColumn(
        "p_value", F.nanvl(tail("f", "df1", "df2"), F.lit(None).cast("double")))


def target_correlations(df: DataFrame, target: str, cols) -> DataFrame:
    """Correlation of every column with the target over pairwise present rows; one aggregate."""
    cols = [c for c in cols if c != target]
    row = df.agg(*[F.corr(F.when(F.col(target).isNotNull(), F.col(c)), F.when(F.col(c).isNotNull(), F.col(target))).alias(
        f"{c}|corr") for c in cols])
    return one_row_to_long(row, cols, {"corr": "double"})


def select_by_corr(df: DataFrame, target: str, cols, threshold: float) -> DataFrame:
    return target_correlations(df, target, cols).filter(F.abs("corr") > threshold)


def select_features(train: DataFrame, test: DataFrame, target: str, numeric, factors, min_corr: float = 0.3,
                    level: float = 0.05) -> list[str]:
    """Numeric columns by correlation and factors by F test, kept where the test table has them."""
    picked = [r["column"] for r in select_by_corr(train, target, numeric, min_corr).orderBy("column").collect()]
    picked += [r["factor"] for r in anova(train, factors, target).filter(F.col("p_value") < level).orderBy("factor").collect()]
    have = set(test.columns)
    return [c for c in picked if c in have]


@dataclass
class Fit:
    """Least-squares fit. The numbers are small (columns by columns); row work stays in Spark."""

    y: str
    x: list[str]
    n: int
    means: np.ndarray
    beta: np.ndarray         # intercept first
    xtx_inv: np.ndarray      # of the centred design with intercept
    sse: float
    sst: float

    @property
    def p(self) -> int:
        return len(self.beta)

    def variance(self, ml: bool = False) -> float:
        return self.sse / (self.n if ml else self.n - self.p)

    def standard_errors(self, ml: bool = False) -> np.ndarray:
        shift = np.eye(self.p)
        shift[0, 1:] = -self.means       # back from centred columns to the raw intercept
        cov = shift @ self.xtx_inv @ shift.T
        return np.sqrt(np.diag(cov) * self.variance(ml))

    @property
    def r2(self) -> float:
        return 1.0 - self.sse / self.sst if self.sst > 0 else float("nan")

    def predict(self) -> Column:
        out = F.lit(float(self.beta[0]))
        for c, b in zip(self.x, self.beta[1:]):
            out = out + F.col(c) * F.lit(float(b))
        return out

    def leverage(self) -> Column:
        """Diagonal of the hat matrix as an expression on the row's own columns."""
        z = [F.lit(1.0)] + [F.col(c) - F.lit(float(m)) for c, m in zip(self.x, self.means)]
        out = F.lit(0.0)
        for i, j in combinations_with_replacement(range(self.p), 2):
            out = out + z[i] * z[j] * F.lit(float(self.xtx_inv[i, j]) * (1.0 if i == j else 2.0))
        return out

    def coefficients(self, spark, ml: bool = False, level: float = 0.95) -> DataFrame:
        """Term, estimate, standard error, test statistic, p-value and interval."""
        se = self.standard_errors(ml)
        dof = self.n - self.p
        wide = t_quantile(0.5 + level / 2.0, dof) if dof > 0 else float("nan")
        rows = []
        for name, b, s in zip(["(Intercept)", *self.x], self.beta, se):
            stat = float(b / s) if s > 0 else float("nan")
            pv = z_two_sided(stat) if ml else t_two_sided(stat, dof)
            rows.append((name, float(b), float(s), stat, float(pv), float(b - wide * s), float(b + wide * s)))
        return spark.createDataFrame(
            rows, "term string, estimate double, std_error double, statistic double, p_value double, low double, high double")


def ols(df: DataFrame, y: str, x) -> Fit:
    """Least squares by two aggregates over complete rows: means, then centred cross products.

    Only the p-by-p products reach the driver, whatever the number of rows.
    """
    x = list(x)
    full = df.select(*[F.col(c).cast("double").alias(c) for c in [*x, y]]).dropna()
    first = full.agg(F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(c) for c in [*x, y]]).first()
    n = first["n"]
    if n <= len(x) + 1:
        raise ValueError("fewer complete rows than coefficients")
    centred = {c: F.col(c) - F.lit(first[c]) for c in [*x, y]}
    pairs = list(combinations_with_replacement([*x, y], 2))
    row = full.agg(*[F.sum(centred[a] * centred[b]).alias(f"{i}") for i, (a, b) in enumerate(pairs)]).first()
    cross = {frozenset((a, b)): row[i] for i, (a, b) in enumerate(pairs)}
    sxx = np.array([[cross[frozenset((a, b))] for b in x] for a in x]).reshape(len(x), len(x))
    sxy = np.array([cross[frozenset((a, y))] for a in x])
    syy = cross[frozenset((y,))]
    # Scaled to unit diagonal before inversion, so that units do not spoil the condition.
    scale = np.sqrt(np.diag(sxx))
    if (scale == 0).any():
        raise ValueError("a constant column has no coefficient: " + ", ".join(c for c, s in zip(x, scale) if s == 0))
    inv = np.linalg.inv(sxx / np.outer(scale, scale)) / np.outer(scale, scale)
    slopes = inv @ sxy
    means = np.array([first[c] for c in x])
    full_inv = np.zeros((len(x) + 1, len(x) + 1))
    full_inv[0, 0] = 1.0 / n
    full_inv[1:, 1:] = inv
    return Fit(y, x, n, means, np.concatenate([[first[y] - slopes @ means], slopes]), full_inv,
               float(syy - slopes @ sxy), float(syy))


def confint(fit: Fit, spark, level: float = 0.95) -> DataFrame:
    return fit.coefficients(spark, level=level).select("term", "low", "high")


def path_model(df: DataFrame, y: str, x) -> DataFrame:
    """One-equation path model: coefficients with maximum-likelihood errors and z tests."""
    return ols(df, y, x).coefficients(df.sparkSession, ml=True).select(
        "term", "estimate", "std_error", F.col("statistic").alias("z"), "p_value")


def residuals(fit: Fit, df: DataFrame) -> DataFrame:
    return df.withColumn("fitted", fit.predict()).withColumn("residual", F.col(fit.y) - F.col("fitted"))


def influence(fit: Fit, df: DataFrame) -> DataFrame:
    """Leverage, studentised residuals and Cook's distance, as row expressions."""
    out = residuals(fit, df).withColumn("hat", fit.leverage())
    s = math.sqrt(fit.variance())
    inner = F.col("residual") / F.nullif(F.lit(s) * F.sqrt(F.greatest(1 - F.col("hat"), F.lit(1e-12))), F.lit(0.0))
    out = out.withColumn("rstandard", inner)
    r2 = F.col("rstandard") * F.col("rstandard")
    dof = fit.n - fit.p
    return out.withColumns({
        "rstudent": F.col("rstandard") * F.sqrt((dof - 1) / F.nullif(F.greatest(dof - r2, F.lit(0.0)), F.lit(0.0))),
        "cook": r2 * F.col("hat") / (fit.p * F.greatest(1 - F.col("hat"), F.lit(1e-12)))})


def outlier_test(fit: Fit, df: DataFrame, cutoff: float = 0.05) -> DataFrame:
    """Studentised residuals with Bonferroni p-values below the cut-off, and the largest (all that
    tie for it) in any case.

    The residual at the cut-off is solved once; rows are filtered by it."""
    low, high = 0.0, 1e6
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (low, middle) if t_two_sided(middle, fit.n - fit.p - 1) * fit.n < cutoff else (middle, high)
    found = influence(fit, df).filter(F.col("rstudent").isNotNull())
    best = found.agg(F.max(F.abs("rstudent"))).scalar()
    top = found.filter((F.abs("rstudent") >= low) | (F.abs("rstudent") == best))

    @F.pandas_udf("double")
    def tail(t: pd.Series) -> pd.Series:
        return t.map(lambda v: t_two_sided(float(v), fit.n - fit.p - 1))

    scored = top.withColumn("p_value", tail("rstudent")).withColumn(
        "bonferroni_p", F.least(F.lit(1.0), F.col("p_value") * fit.n))
    return scored.filter((F.col("bonferroni_p") < cutoff) | (F.abs("rstudent") == best))


def vif(df: DataFrame, cols) -> DataFrame:
    """Variance inflation factors: diagonal of the inverse correlation matrix."""
    cols = list(cols)
    cells = {(r["var1"], r["var2"]): r["corr"] for r in corr_matrix(df, cols).collect()}
    inv = np.linalg.inv(np.array([[cells[a, b] for b in cols] for a in cols], dtype=float))
    rows = [(c, float(v), bool(math.sqrt(v) > 2)) for c, v in zip(cols, np.diag(inv))]
    return df.sparkSession.createDataFrame(rows, "column string, vif double, inflated boolean")


def acf(df: DataFrame, keys, order, col: str, max_lag: int | None = None,
        span_rows: int = SPAN_ROWS, split: bool | None = None) -> DataFrame:
    """Autocorrelation of each series for lags 0..max_lag (10 log10 n of the longest by default).

    A series without variance keeps its rows, with NULL."""
    keys = list(keys)
    if max_lag is None:
        max_lag = int(10 * math.log10(max(largest_group(df, keys), 2)))
    means = df.groupBy(*keys).agg(F.avg(col).alias("_m"))
    dev = null_safe_join(df, means, keys).withColumn("_e", F.col(col) - F.col("_m"))
    wide = over_rows(dev, keys, order, lambda w: {f"_e{k}": F.lag("_e", k).over(w) for k in range(1, max_lag + 1)},
                     before=max_lag, span_rows=span_rows, split=split).withColumn("_e0", F.col("_e"))
    sums = wide.groupBy(*keys).agg(*[F.sum(F.col("_e") * F.col(f"_e{k}")).alias(f"_c{k}") for k in range(max_lag + 1)])
    items = F.array(*[F.struct(F.lit(k).alias("lag"), (F.col(f"_c{k}") / F.nullif(F.col("_c0"), F.lit(0.0))).alias("acf"),
                              F.col(f"_c{k}").alias("_sum"))
                      for k in range(max_lag + 1)])
    return sums.select(*keys, F.explode(items).alias("_x")).select(*keys, "_x.*").filter("_sum IS NOT NULL").drop("_sum")


def decompose(df: DataFrame, keys, order, col: str, period: int, span_rows: int = SPAN_ROWS,
              split: bool | None = None) -> DataFrame:
    """Trend by centred moving average, seasonal means by phase (centred on zero), remainder."""
    keys = list(keys)
    half = period // 2
    placed = with_position(df, order, keys, "_i", span_rows, split)

    def trend(w):
        n = F.count(col).over(w.rowsBetween(-half, half))
        if period % 2:
            total = F.sum(col).over(w.rowsBetween(-half, half))
        else:
            total = (F.sum(col).over(w.rowsBetween(-half, half))
                     - (F.lag(col, half).over(w) + F.lead(col, half).over(w)) / 2.0)
        return {"trend": F.when(n == 2 * half + 1, total / period)}

    out = over_rows(placed, keys, ["_i"], trend, half, half, span_rows, split).withColumn(
        "phase", ((F.col("_i") - 1) % period).cast("int"))
    phases = out.groupBy(*keys, "phase").agg(F.avg(F.col(col) - F.col("trend")).alias("_s"))
    centre = phases.groupBy(*keys).agg(F.avg("_s").alias("_sm"))
    seasonal = null_safe_join(phases, centre, keys).select(*keys, "phase", (F.col("_s") - F.col("_sm")).alias("seasonal"))
    out = null_safe_join(out, seasonal, [*keys, "phase"])
    return out.withColumn("remainder", F.col(col) - F.col("trend") - F.col("seasonal")).drop("_i")


def term_freq(df: DataFrame, col: str, stopwords=STOPWORDS, n: int | None = 100, min_length: int = 3) -> DataFrame:
    """Most frequent words: lower case, without punctuation, digits and stop words."""
    from tabkit.functions.scalars import strip_digits, strip_punctuation

    words = F.split(strip_digits(strip_punctuation(F.lower(F.col(col)))), r"\s+")
    terms = df.select(F.explode(words).alias("term")).filter(
        (F.length("term") >= min_length) & ~F.col("term").isin(list(stopwords)))
    counts = freq(terms, "term")
    return counts if n is None else head_by(counts, [F.desc("n"), "term"], n)


def group_profile(df: DataFrame, key: str, group: str, values) -> DataFrame:
    """Rows, share in percent and mean of the given columns per group."""
    shares = freq(df, group, pct=True)
    means = df.groupBy(group).agg(*[F.avg(v).alias(f"{v}_mean") for v in values])
    return null_safe_join(shares, means, [group])
