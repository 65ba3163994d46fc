"""Scores of predictions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabkit.operators.agg import crosstab_wide
from tabkit.operators.order import SPAN_ROWS, running_totals


def rmse(df: DataFrame, y: str, yhat: str, by=()) -> DataFrame:
    err = F.col(y) - F.col(yhat)
    return df.groupBy(*by).agg(F.sqrt(F.avg(err * err)).alias("rmse"))


def mae(df: DataFrame, y: str, yhat: str, by=()) -> DataFrame:
    return df.groupBy(*by).agg(F.avg(F.abs(F.col(y) - F.col(yhat))).alias("mae"))


def r2_corr(df: DataFrame, y: str, yhat: str, by=()) -> DataFrame:
    """Squared correlation of actual and predicted values."""
    return df.groupBy(*by).agg(F.pow(F.corr(y, yhat), F.lit(2.0)).alias("r2"))


def accuracy(df: DataFrame, y: str, yhat: str, by=()) -> DataFrame:
    hit = F.col(y).eqNullSafe(F.col(yhat)).cast("double")
    return df.groupBy(*by).agg(F.avg(hit).alias("accuracy"))


def confusion(df: DataFrame, y: str, yhat: str, levels: list) -> DataFrame:
    """Rows: actual class; columns: predicted class."""
    return crosstab_wide(df, y, yhat, levels)


def class_report(df: DataFrame, y: str, yhat: str) -> DataFrame:
    """Precision, recall, F1 and support per class, with plain and weighted averages."""
    pairs = df.filter(F.col(y).isNotNull() & F.col(yhat).isNotNull()).groupBy(
        F.col(y).cast("string").alias("_y"), F.col(yhat).cast("string").alias("_p")).agg(F.count(F.lit(1)).alias("_n"))
    sides = pairs.select(F.explode(F.array(
        F.struct(F.col("_y").alias("class"), F.col("_n").alias("s"), F.lit(0).cast("bigint").alias("p"),
                 F.when(F.col("_y") == F.col("_p"), F.col("_n")).otherwise(0).alias("t")),
        F.struct(F.col("_p").alias("class"), F.lit(0).cast("bigint").alias("s"), F.col("_n").alias("p"),
                 F.lit(0).cast("bigint").alias("t")))).alias("_x")).select("_x.*")
    sums = sides.groupBy("class").agg(F.sum("t").alias("t"), F.sum("p").alias("p"), F.sum("s").alias("support"))
    zero = F.lit(0.0)
    scored = sums.withColumns({
        "precision": F.coalesce(F.col("t") / F.nullif("p", F.lit(0)), zero),
        "recall": F.coalesce(F.col("t") / F.nullif("support", F.lit(0)), zero)}).withColumn(
        "f1", F.coalesce(2 * F.col("precision") * F.col("recall") / F.nullif(F.col("precision") + F.col("recall"), zero), zero))
    names = ["precision", "recall", "f1"]
    macro = scored.agg(*[F.avg(c).alias(c) for c in names], F.sum("support").alias("support")).select(
        F.lit("macro avg").alias("class"), *names, "support")
    weighted = scored.agg(*[(F.sum(F.col(c) * F.col("support")) / F.sum("support")).alias(c) for c in names],
                          F.sum("support").alias("support")).select(F.lit("weighted avg").alias("class"), *names, "support")
    return scored.select("class", *names, "support").unionByName(macro).unionByName(weighted)


def auc_by_class(df: DataFrame, y: str, scores: dict, span_rows: int = SPAN_ROWS) -> DataFrame:
    """One-vs-rest area under the ROC curve per class; ``scores`` maps class to score column.

    Equal scores are counted together and get their average rank. A class without positives
    or negatives has no value.
    """
    long = df.select(F.explode(F.array(*[
        F.struct(F.lit(str(k)).alias("class"), F.col(c).cast("double").alias("score"),
                 (F.col(y).cast("string") == str(k)).cast("bigint").alias("pos")) for k, c in scores.items()
    ])).alias("_x")).select("_x.*")
    counts = long.groupBy("class", "score").agg(F.sum("pos").alias("pos"), F.sum(1 - F.col("pos")).alias("neg"))
    run = running_totals(counts, ["class"], "score", ["neg", "pos"], span_rows)
    below = F.col("neg_cum") - F.col("neg") + F.col("neg") / 2.0
    return run.groupBy("class").agg(
        (F.sum(F.col("pos") * below) / F.nullif(F.max("pos_total") * F.max("neg_total"), F.lit(0))).alias("auc"))


def auc_ovr(df: DataFrame, y: str, scores: dict, span_rows: int = SPAN_ROWS) -> DataFrame:
    """Mean of the one-vs-rest areas over the classes that have one."""
    return auc_by_class(df, y, scores, span_rows).agg(F.avg("auc").alias("auc"))


def fold_mean(scores: DataFrame, col: str, root: bool = False) -> DataFrame:
    """Mean score over folds; with ``root`` the square root of the mean."""
    mean = F.avg(col)
    return scores.agg((F.sqrt(mean) if root else mean).alias(col))


def compare(pred: DataFrame, actual: DataFrame, key: str, pred_col: str, actual_col: str) -> DataFrame:
    """Predicted and actual value side by side, with agreement."""
    both = pred.select(key, F.col(pred_col).alias("predicted")).join(
        actual.select(key, F.col(actual_col).alias("actual")), key)
    return both.withColumn("same", F.col("predicted") == F.col("actual"))
