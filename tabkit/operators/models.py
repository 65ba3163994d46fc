"""Model fitting, search and inspection on MLlib."""

from __future__ import annotations

import random

import numpy as np
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.ml.tuning import CrossValidator
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabkit.functions.scalars import hash_text, hash_unit
from tabkit.operators.linear import LinearFit, LinearModel
from tabkit.operators.order import SPAN_ROWS, with_position
from tabkit.operators.rows import kfold
from tabkit.sources.workspace import checkpointed


def features(numeric, categorical=(), one_hot: bool = True, out: str = "features") -> list:
    """Pipeline stages from columns to a feature vector; unseen categories get their own place."""
    numeric, categorical = list(numeric), list(categorical)
    stages, names = [], list(numeric)
    if categorical:
        stages.append(StringIndexer(inputCols=categorical, outputCols=[f"{c}__i" for c in categorical],
                                    handleInvalid="keep", stringOrderType="alphabetAsc"))
        names += [f"{c}__i" for c in categorical]
        if one_hot:
            stages.append(OneHotEncoder(inputCols=[f"{c}__i" for c in categorical],
                                        outputCols=[f"{c}__v" for c in categorical], handleInvalid="keep"))
            names = numeric + [f"{c}__v" for c in categorical]
    return [*stages, VectorAssembler(inputCols=names, outputCol=out)]


def pipeline(estimator, numeric, categorical=(), one_hot: bool = True) -> Pipeline:
    return Pipeline(stages=[*features(numeric, categorical, one_hot), estimator])


def logit(df: DataFrame, y: str, numeric, categorical=(), threshold: float = 0.5) -> tuple[LinearFit, DataFrame]:
    """Logistic model; predictions carry ``prediction`` (probability) and ``class``."""
    model = LinearModel(y, list(numeric), list(categorical), "binomial").fit(df)
    return model, model.transform(df).withColumn("class", (F.col("prediction") > threshold).cast("int"))


def glm_summary(model: LinearFit, spark) -> DataFrame:
    """Terms of a fitted linear model with errors and p-values; factors are named by their level."""
    return model.table(spark)


def log_linear(df: DataFrame, y: str, numeric, categorical=()) -> LinearFit:
    """Gaussian model of log1p(y) on numbers and factors; predictions are on the scale of y."""
    return LinearModel(y, list(numeric), list(categorical), response="log1p").fit(df)


def log_linear_predict(model: LinearFit, df: DataFrame) -> DataFrame:
    return model.transform(df).select(*df.columns, "prediction")


def linear_model(y: str, numeric, categorical=()) -> LinearModel:
    return LinearModel(y, list(numeric), list(categorical))


def forest_classifier(y: str, numeric, categorical=(), trees: int = 100, **params) -> Pipeline:
    return pipeline(RandomForestClassifier(labelCol=y, numTrees=trees, **params), numeric, categorical, one_hot=False)


def forest_regressor(y: str, numeric, categorical=(), trees: int = 100, **params) -> Pipeline:
    return pipeline(RandomForestRegressor(labelCol=y, numTrees=trees, **params), numeric, categorical, one_hot=False)


def gbt_regressor(y: str, numeric, categorical=(), rounds: int = 100, rate: float = 0.1, depth: int = 3,
                  valid: str | None = None, **params) -> Pipeline:
    """Boosted trees; with ``valid`` (a boolean column) boosting stops when its rows stop improving."""
    est = GBTRegressor(labelCol=y, maxIter=rounds, stepSize=rate, maxDepth=depth, **params)
    if valid:
        est = est.setValidationIndicatorCol(valid)
    return pipeline(est, numeric, categorical, one_hot=False)


def grid_search(est, grid, df: DataFrame, key: str, k: int, evaluator, seed: int = 0, parallelism: int = 4):
    """Exhaustive search with k-fold validation; folds come from a hash of the key."""
    cv = CrossValidator(estimator=est, estimatorParamMaps=grid, evaluator=evaluator, numFolds=k, foldCol="fold",
                        parallelism=parallelism, seed=seed)
    return cv.fit(checkpointed(kfold(df, key, k, seed)))


def search_results(cv_model, spark) -> DataFrame:
    """Settings and mean score of every candidate."""
    rows = [(i, "; ".join(f"{p.name}={v}" for p, v in sorted(m.items(), key=lambda t: t[0].name)), float(s))
            for i, (m, s) in enumerate(zip(cv_model.getEstimatorParamMaps(), cv_model.avgMetrics))]
    return spark.createDataFrame(rows, "candidate int, settings string, score double")


def cross_val(est, df: DataFrame, key: str, k: int, evaluator, seed: int = 0) -> DataFrame:
    """Score of one estimator on each of k folds."""
    folded = checkpointed(kfold(df, key, k, seed))
    rows = []
    for i in range(k):
        model = est.fit(folded.filter(F.col("fold") != i))
        rows.append((i, float(evaluator.evaluate(model.transform(folded.filter(F.col("fold") == i))))))
    return df.sparkSession.createDataFrame(rows, "fold int, score double")


def sample_space(space: dict, n_trials: int, seed: int) -> list[dict]:
    """Random settings. A range is (low, high, 'log' | 'linear' | 'int'), a list is a choice."""
    rng = random.Random(seed)
    trials = []
    for _ in range(n_trials):
        trial = {}
        for param, spec in space.items():
            if isinstance(spec, list):
                trial[param] = rng.choice(spec)
                continue
            low, high, scale = spec
            if scale == "log":
                trial[param] = float(np.exp(rng.uniform(np.log(low), np.log(high))))
            else:
                trial[param] = rng.randint(low, high) if scale == "int" else rng.uniform(low, high)
        trials.append(trial)
    return trials


def random_search(est, space: dict, n_trials: int, df: DataFrame, key: str, k: int, evaluator, seed: int = 0,
                  parallelism: int = 4):
    return grid_search(est, sample_space(space, n_trials, seed), df, key, k, evaluator, seed, parallelism)


def halving_search(est, space: dict, n_trials: int, df: DataFrame, key: str, evaluator, eta: int = 3, seed: int = 0,
                   least: float | None = None, valid: float = 0.25) -> tuple[DataFrame, object]:
    """Random settings under a budget of rows: successive halving on nested hashed samples.

    A share ``valid`` of the rows, by a hash of the key, judges every setting. All settings are fitted on a small
    sample of the others; the best 1/``eta`` go on to a sample ``eta`` times as large that holds the
    one before, until one is fitted on all. ``least`` is the first sample's share, by default so that the last
    rung is the first with one setting. Returns the report (rung, share, candidate, settings, score, kept) and the last rung's best model.
    """
    trials = sample_space(space, n_trials, seed)
    rungs, left = 1, n_trials
    while left > 1:
        left, rungs = max(1, left // eta), rungs + 1
    share = least if least is not None else float(eta) ** (1 - rungs)
    rows = checkpointed(df.withColumns({"_judge": hash_unit(F.col(key), seed=seed) < valid, "_at": hash_unit(F.col(key), seed=seed + 1)}))
    judge, train = rows.filter("_judge"), rows.filter("NOT _judge")
    alive, report, best = list(range(n_trials)), [], None
    sign = 1.0 if evaluator.isLargerBetter() else -1.0
    for rung in range(rungs):
        share = 1.0 if rung == rungs - 1 else min(1.0, share)
        sample = train.filter(F.col("_at") < share)
        scored = []
        for c in alive:
            model = est.copy(trials[c]).fit(sample)
            scored.append((c, float(evaluator.evaluate(model.transform(judge))), model))
        scored.sort(key=lambda s: (-sign * s[1], s[0]))
        keep = max(1, len(alive) // eta) if rung < rungs - 1 else 1
        kept = {c for c, _, _ in scored[:keep]}
        settings = lambda c: "; ".join(f"{p.name}={v}" for p, v in sorted(trials[c].items(), key=lambda t: t[0].name))     # noqa: E731
        report += [(rung, share, c, settings(c), score, c in kept) for c, score, _ in sorted(scored, key=lambda s: s[0])]
        alive, best, share = sorted(kept), scored[0][2], share * eta
    return df.sparkSession.createDataFrame(report, "rung int, share double, candidate int, settings string, score double, kept boolean"), best


def bootstrap_fit(make, df: DataFrame, key: str, n: int, seed: int = 0) -> list:
    """n models, each on a Poisson bootstrap of the rows drawn by a hash of the key.

    ``make(weight_column)`` returns the estimator; the draw is its row weight.
    """
    models, df = [], checkpointed(df)
    for i in range(n):
        u = hash_unit(F.col(key), seed=seed + i)
        # Cumulative Poisson(1) probabilities of 0, 1, 2, 3 and 4.
        steps = (0.36787944, 0.73575888, 0.9196986, 0.98101184, 0.99634015)
        weight = F.lit(float(len(steps)))
        for count, limit in reversed(list(enumerate(steps))):
            weight = F.when(u < limit, float(count)).otherwise(weight)
        drawn = df.withColumn("_weight", weight).filter("_weight > 0")
        models.append(make("_weight").fit(drawn))
    return models


def ensemble_predict(models, df: DataFrame) -> DataFrame:
    """Mean and standard deviation of the predictions of several models, row by row."""
    out = df
    for i, m in enumerate(models):
        keep = out.columns
        out = m.transform(out).select(*keep, F.col("prediction").alias(f"_p{i}"))
    p = F.array(*[F.col(f"_p{i}") for i in range(len(models))])
    mean = F.aggregate(p, F.lit(0.0), lambda a, b: a + b) / len(models)
    out = out.withColumn("mean", mean)
    spread = F.sqrt(F.aggregate(F.transform(p, lambda v: (v - F.col("mean")) * (v - F.col("mean"))), F.lit(0.0),
                                lambda a, b: a + b) / len(models))
    return out.withColumn("sd", spread).drop(*[f"_p{i}" for i in range(len(models))])


def importances(model: PipelineModel, names, spark) -> DataFrame:
    """Feature importances of a tree model, largest first."""
    values = model.stages[-1].featureImportances.toArray()
    if len(values) != len(names):
        raise ValueError(f"{len(names)} names for {len(values)} features")
    rows = sorted(((n, float(v)) for n, v in zip(names, values)), key=lambda r: (-r[1], r[0]))
    return spark.createDataFrame(rows, "feature string, importance double")


def permutation_importance(model: PipelineModel, df: DataFrame, key: str, y: str, names, seed: int = 0,
                           span_rows: int = SPAN_ROWS) -> DataFrame:
    """Percent increase of the squared error when one column is shuffled.

    Rows in key order meet the same rows in random order by position, which shuffles every
    column once; the join is written once and scored column by column.
    """
    names = list(names)
    a = with_position(df, [key], name="_at", span_rows=span_rows)
    b = with_position(df.select(key, *[F.col(c).alias(f"_s_{c}") for c in names]),
                      [hash_text(F.col(key), seed=seed), key], name="_at", span_rows=span_rows).drop(key)
    both = checkpointed(a.join(b, "_at"))

    def mse(frame):
        err = F.col("prediction") - F.col(y)
        return model.transform(frame).agg(F.avg(err * err)).first()[0]

    base = mse(both)
    rows = [(c, float((mse(both.withColumn(c, F.col(f"_s_{c}"))) - base) / base * 100.0)) for c in names]
    return df.sparkSession.createDataFrame(rows, "feature string, increase_pct double")


def fit_predict(est, train: DataFrame, test: DataFrame) -> DataFrame:
    """Fit the chosen settings on all training rows and predict the test rows."""
    best = getattr(est, "bestModel", None)
    model = best if best is not None else est.fit(train)
    return model.transform(test).select(*test.columns, "prediction")
