"""Linear and logistic models with factors, and the lasso, from cross products.

A pass over the rows sums the products of the design's columns map-side; what follows works on
columns-by-columns numbers. Factors are coded against their first level. A column that those before it
explain has no coefficient, as in a table of a linear model with aliased terms.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabkit.functions.numerics import t_two_sided, z_two_sided
from tabkit.operators.moments import Elimination, product_sums, symmetric
from tabkit.operators.rows import kfold

INTERCEPT = "(Intercept)"


@dataclass
class Design:
    """Intercept, centred numbers, and for each factor a column per level but the first.

    Levels are the columns of the model, so they are listed; ``centre`` only steadies the sums.
    """
    numeric: list[str]
    levels: dict[str, list[str]]
    centre: dict[str, float]

    @classmethod
    def of(cls, df: DataFrame, numeric, categorical) -> Design:
        numeric, categorical = list(numeric), list(categorical)
        means = df.agg(*[F.avg(c).alias(c) for c in numeric], F.count(F.lit(1)).alias("_n")).first()
        levels = {c: sorted(str(r[0]) for r in df.select(c).filter(F.col(c).isNotNull()).distinct().collect()) for c in categorical}
        return cls(numeric, levels, {c: float(means[c] or 0.0) for c in numeric})

    @property
    def terms(self) -> list[str]:
        return [INTERCEPT, *self.numeric, *[f"{c}{v}" for c, vs in self.levels.items() for v in vs[1:]]]

    def columns(self) -> list[Column]:
        """NULL wherever a number is missing or a level is unknown."""
        out = [F.lit(1.0), *[F.col(c).cast("double") - F.lit(m) for c, m in self.centre.items()]]
        for c, known in self.levels.items():
            value = F.col(c).cast("string")
            fits = value.isin(known) if known else F.lit(False)
            out += [F.when(fits, (value == v).cast("double")) for v in known[1:]] or []
        return out

    def complete(self) -> Column:
        ok = F.lit(True)
        for c in self.numeric:
            ok = ok & F.col(c).isNotNull()
        for c, known in self.levels.items():
            ok = ok & (F.col(c).cast("string").isin(known) if known else F.lit(False))
        return ok


def _moments(df: DataFrame, columns: list[Column], keys=()) -> dict:
    size = len(columns)
    rows = df.select(*keys, F.array(*columns).cast("array<double>").alias("_z"))
    return {tuple(r[k] for k in keys): symmetric(np.array([r["_sums"]]), size)[0] for r in product_sums(rows, list(keys), "_z", size, "_sums").collect()}


@dataclass
class LinearFit:
    """A fitted model. Aliased terms have no estimate; predictions leave them out."""
    design: Design
    family: str
    response: str
    estimate: list[float | None]
    std_error: list[float | None]
    statistic: list[float | None]
    p_value: list[float | None]
    n: int
    deviance: float
    rounds: int = 1
    separated: bool = field(default=False)

    def table(self, spark: SparkSession) -> DataFrame:
        """One row per term in the design's order. The intercept is at zero of all numbers."""
        rows = list(zip(self.design.terms, self.estimate, self.std_error, self.statistic, self.p_value))
        return spark.createDataFrame(rows, "term string, estimate double, std_error double, statistic double, p_value double")

    def link(self) -> Column:
        """The linear predictor of a row; NULL where a value is missing or a level was not fitted."""
        value = F.lit(self.estimate[0])
        for name, b in zip(self.design.numeric, self.estimate[1:]):
            value = value + (F.col(name).cast("double") * F.lit(b) if b is not None else F.lit(0.0))
        at = 1 + len(self.design.numeric)
        for c, known in self.design.levels.items():
            effects = dict(zip(known, [0.0, *[b or 0.0 for b in self.estimate[at:at + len(known) - 1]]]))
            at += max(len(known) - 1, 0)
            pairs = [x for v, b in effects.items() for x in (F.lit(v), F.lit(float(b)))]
            value = value + (F.element_at(F.create_map(*pairs), F.col(c).cast("string")) if pairs else F.lit(None).cast("double"))
        return F.when(self.design.complete(), value)

    def transform(self, df: DataFrame) -> DataFrame:
        """Add ``prediction``, on the scale of the response."""
        link = self.link()
        if self.family == "binomial":
            link = 1.0 / (1.0 + F.exp(-link))
        elif self.response == "log1p":
            link = F.expm1(link)
        return df.withColumn("prediction", link)

    def save(self, spark: SparkSession, path: str) -> str:
        spark.createDataFrame([(json.dumps(asdict(self)),)], "model string").coalesce(1).write.mode("overwrite").text(path)
        return path

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> LinearFit:
        about = json.loads(spark.read.text(path).first()[0])
        return cls(**about | {"design": Design(**about["design"])})


def _uncentred(design: Design, beta: np.ndarray, cover: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Estimates and their covariance with the intercept at zero of the numbers instead of at their means."""
    shift = np.eye(len(beta))
    shift[0, 1:1 + len(design.numeric)] = [-design.centre[c] for c in design.numeric]
    return shift @ beta, shift @ cover @ shift.T


def _solve(moments: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Coefficients, which columns have one, the inverse of their products, and the residual sum of squares."""
    size = len(moments) - 1
    scale = np.sqrt(np.maximum(np.diagonal(moments), 1e-300))
    steps = Elimination((moments / np.outer(scale, scale))[None])
    for k in range(size):
        steps.take(k)
    kept = steps.taken[0, :size]
    beta, inverse = np.zeros(size), np.zeros((size, size))
    at = np.flatnonzero(kept)
    if len(at):
        small = (moments / np.outer(scale, scale))[np.ix_(at, at)]
        inverse[np.ix_(at, at)] = np.linalg.inv(small) / np.outer(scale[at], scale[at])
        beta[at] = steps.coefficients[0, at] * scale[-1] / scale[at]
    return beta, kept, inverse, float(steps.residual[0] * scale[-1] ** 2)


@dataclass
class LinearModel:
    """A model to be fitted: ``family`` 'gaussian' or 'binomial', ``response`` 'identity' or 'log1p'.

    Rows with a missing number, factor or response are left out. The binomial model is fitted by
    reweighted least squares, one pass over the rows for each round.
    """
    y: str
    numeric: list[str]
    categorical: list[str] = field(default_factory=list)
    family: str = "gaussian"
    response: str = "identity"
    weight: str | None = None

    def fit(self, df: DataFrame) -> LinearFit:
        if self.family not in ("gaussian", "binomial") or self.response not in ("identity", "log1p"):
            raise ValueError(f"unknown family {self.family!r} or response {self.response!r}")
        y = F.col(self.y).cast("double")
        y = F.log1p(y) if self.response == "log1p" else y
        df = df.filter(y.isNotNull())
        design = Design.of(df, self.numeric, self.categorical)
        rows = df.filter(design.complete())
        w = F.col(self.weight).cast("double") if self.weight else F.lit(1.0)
        if self.family == "binomial":
            return self._binomial(rows, design, y, w)
        found = _moments(rows, [F.sqrt(w) * c for c in (*design.columns(), y)])
        if not found:
            raise ValueError("no complete rows to fit")
        n = rows.filter(w > 0).count() if self.weight else int(found[()][0, 0])
        beta, kept, inverse, sse = _solve(found[()])
        left = n - int(kept.sum())
        sigma = sse / left if left > 0 else float("nan")
        return self._made(design, beta, kept, inverse * sigma, n, sse, 1, lambda t: t_two_sided(t, left))

    def _binomial(self, rows: DataFrame, design: Design, y: Column, weight: Column) -> LinearFit:
        size, deviance, beta = len(design.terms), None, None
        for rounds in range(1, 26):
            columns = design.columns()
            if beta is None:
                mu = (weight * y + 0.5) / (weight + 1.0)
                eta = F.log(mu / (1.0 - mu))
            else:
                eta = sum((c * F.lit(float(b)) for c, b in zip(columns[1:], beta[1:])), F.lit(float(beta[0])))
                mu = 1.0 / (1.0 + F.exp(-eta))
            ready = rows.select(F.array(*columns).cast("array<double>").alias("_x"), y.alias("_y"), weight.alias("_w"), eta.alias("_eta"), mu.alias("_mu"))
            var = F.greatest(F.col("_mu") * (1.0 - F.col("_mu")), F.lit(1e-10))
            root = F.sqrt(F.col("_w") * var)
            target = F.col("_eta") + (F.col("_y") - F.col("_mu")) / var
            soft = F.greatest(F.lit(1e-300), F.when(F.col("_y") > 0.5, F.col("_mu")).otherwise(1.0 - F.col("_mu")))
            z = ready.select("_w", soft.alias("_soft"), root.alias("_root"), target.alias("_t"), "_x").select(
                F.concat(F.transform("_x", lambda v: v * F.col("_root")), F.array(F.col("_root") * F.col("_t"), F.sqrt(F.col("_w") * -2.0 * F.log("_soft")))).alias("_z"))
            got = product_sums(z, [], "_z", size + 2, "_sums").collect()
            if not got:
                raise ValueError("no complete rows to fit")
            full = symmetric(np.array([got[0]["_sums"]]), size + 2)[0]
            # The last place carries the square root of each row's deviance at the coefficients of the round before.
            before, now = deviance, full[-1, -1] if beta is not None else None
            deviance = now
            beta, kept, inverse, _ = _solve(full[:-1, :-1])
            if before is not None and abs(now - before) < 1e-8 * (abs(now) + 0.1):
                break
        n = rows.count()
        fit = self._made(design, beta, kept, inverse, n, float(now), rounds, z_two_sided)
        fit.separated = rounds == 25
        return fit

    def _made(self, design, beta, kept, cover, n, deviance, rounds, tail) -> LinearFit:
        beta, cover = _uncentred(design, beta, cover)
        error = np.sqrt(np.maximum(np.diagonal(cover), 0.0))
        ratio = [float(b / e) if e > 0 else float("nan") for b, e in zip(beta, error)]
        pick = lambda values: [float(v) if k else None for v, k in zip(values, kept)]          # noqa: E731
        return LinearFit(design, self.family, self.response, pick(beta), pick(error), pick(ratio), pick([tail(t) for t in ratio]), n, deviance, rounds)


@dataclass
class LassoFit:
    """The lasso along its path: cross-validated error of each penalty, and the coefficients at the best."""
    design: Design
    penalties: list[float]
    error: list[float]
    error_se: list[float]
    path: np.ndarray
    best: int

    def table(self, spark: SparkSession) -> DataFrame:
        rows = [(i, float(p), float(e), float(s), int((b[1:] != 0).sum())) for i, (p, e, s, b) in enumerate(zip(self.penalties, self.error, self.error_se, self.path))]
        return spark.createDataFrame(rows, "step int, penalty double, error double, error_se double, terms int")

    def fit_at(self, step: int | None = None) -> LinearFit:
        """The model at a step of the path, by default that of least cross-validated error."""
        beta = self.path[self.best if step is None else step]
        nothing = [None] * len(beta)
        return LinearFit(self.design, "gaussian", "identity", [float(b) for b in beta], nothing, nothing, nothing, 0, float("nan"))


def _descend(gram: np.ndarray, cross: np.ndarray, penalties: np.ndarray, tolerance: float) -> np.ndarray:
    """Coefficients of standardised columns for each penalty, for a stack of problems at once, each
    penalty starting from the one before. ``gram`` has ones on its diagonal, or zeros for constant columns."""
    folds, d = cross.shape
    beta, out = np.zeros((folds, d)), np.zeros((len(penalties), folds, d))
    live = np.diagonal(gram, axis1=1, axis2=2) > 0
    left = cross.copy()                                                  # cross products with the residual
    for step, penalty in enumerate(penalties):
        for _ in range(10_000):
            largest = 0.0
            for j in range(d):
                old = beta[:, j].copy()
                part = left[:, j] + old
                new = np.where(live[:, j], np.sign(part) * np.maximum(np.abs(part) - penalty, 0.0), 0.0)
                change = new - old
                if change.any():
                    beta[:, j] = new
                    left -= change[:, None] * gram[:, :, j]
                    largest = max(largest, float(np.abs(change).max()))
            if largest <= tolerance:
                break
        out[step] = beta
    return out


def _standardised(moments: np.ndarray) -> tuple[np.ndarray, ...]:
    """Means, spreads, correlations of columns and their cross products with the response, per matrix of a stack."""
    n = moments[:, 0, 0]
    mean = moments[:, 0, 1:] / n[:, None]
    cover = moments[:, 1:, 1:] / n[:, None, None] - mean[:, :, None] * mean[:, None, :]
    spread = np.sqrt(np.maximum(np.diagonal(cover, axis1=1, axis2=2), 0.0))[:, :-1]
    spread = np.where(spread > 1e-12 * np.maximum(np.abs(mean[:, :-1]), 1.0), spread, 0.0)
    safe = np.where(spread > 0, spread, 1.0)
    gram = cover[:, :-1, :-1] / (safe[:, :, None] * safe[:, None, :])
    dead = spread == 0
    gram[dead] = 0.0
    gram = np.where(dead[:, None, :], 0.0, gram)
    at = np.arange(gram.shape[1])
    gram[:, at, at] = np.where(dead, 0.0, 1.0)
    return mean, safe, gram, np.where(dead, 0.0, cover[:, :-1, -1] / safe)


def lasso(df: DataFrame, y: str, key: str, numeric, categorical=(), k: int = 50, n: int = 100, ratio: float = 1e-4, seed: int = 0,
          tolerance: float = 1e-9) -> LassoFit:
    """Lasso over ``n`` penalties, from the smallest that empties the model down by ``ratio``, evenly in the
    log, judged by ``k``-fold cross-validation.

    Columns are standardised within what each fit sees. One pass sums the products of each fold; a fit
    without a fold works on the total less the fold's products, all folds side by side, and the error on
    the fold follows from its products as well. Folds are a hash of the key. Rows with gaps are left out.
    """
    rows = df.filter(F.col(y).isNotNull())
    design = Design.of(rows, numeric, categorical)
    rows = kfold(rows.filter(design.complete()), key, k, seed)
    mean_y = rows.agg(F.avg(y)).first()[0] or 0.0
    found = _moments(rows, [*design.columns(), F.col(y).cast("double") - F.lit(float(mean_y))], ["fold"])
    if not found:
        raise ValueError("no complete rows to fit")
    parts = np.array([found[f] for f in sorted(found)])
    total = parts.sum(0)
    stack = np.concatenate([total[None], total - parts])
    use = stack[:, 0, 0] > 0
    mean, spread, gram, cross = _standardised(np.where(use[:, None, None], stack, total))
    top = float(np.abs(cross[0]).max()) if cross.shape[1] else 0.0
    penalties = np.geomspace(top, top * ratio, n) if top > 0 else np.zeros(1)
    beta = _descend(gram, cross, penalties, tolerance * max(top, 1e-300)) / spread
    start = mean[None, :, -1] - (beta * mean[None, :, :-1]).sum(2)
    full = np.concatenate([start[:, :, None], beta], 2)                  # penalties x (all, folds) x terms
    miss = np.concatenate([full[:, 1:], -np.ones((len(penalties), len(parts), 1))], 2)
    sse = np.einsum("pfi,fij,pfj->pf", miss, parts, miss)
    size = parts[:, 0, 0]
    error = sse.sum(1) / size.sum()
    se = np.sqrt((((sse / size - error[:, None]) ** 2) * size).sum(1) / size.sum() / max(len(parts) - 1, 1))
    path = full[:, 0].copy()
    path[:, 0] += mean_y - path[:, 1:1 + len(design.numeric)] @ np.array([design.centre[c] for c in design.numeric])
    return LassoFit(design, [float(p) for p in penalties], [float(e) for e in error], [float(s) for s in se], path, int(np.argmin(error)))
