"""Result tables and stored models."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabkit.functions.scalars import round_even
from tabkit.operators.linear import LinearFit


def write_table(df: DataFrame, path: str, parts: int | None = None) -> str:
    """CSV with header. Files follow the partitions of the frame; ``parts`` sets their number.

    ``parts=1`` gives the one file a small result table needs; leave it unset for results
    that grow with the data, since one file is written by one task.
    """
    out = df if parts is None else df.repartition(parts)
    out.write.mode("overwrite").option("header", True).option("escape", "\"").csv(path)
    return path


def submission(pred: DataFrame, id_col: str, pred_col: str, out_col: str, inverse: str | None = None,
               digits: int | None = None, lower: float | None = None, id_out: str | None = None) -> DataFrame:
    """Key and prediction, brought back to the original scale, rounded half to even and clipped."""
    value = F.col(pred_col).cast("double")
    if inverse == "expm1":
        value = F.expm1(value)
    elif inverse == "exp":
        value = F.exp(value)
    elif inverse is not None:
        raise ValueError(f"unknown inverse {inverse!r}")
    if digits is not None:
        value = round_even(value, digits)
    if lower is not None:
        value = F.greatest(F.lit(float(lower)), F.coalesce(value, F.lit(float(lower))))
    return pred.select(F.col(id_col).alias(id_out or id_col), value.alias(out_col))


def save_model(model, path: str) -> str:
    """A fitted pipeline in MLlib's own form, or a linear model as one line of text."""
    if isinstance(model, LinearFit):
        return model.save(SparkSession.active(), path)
    model.write().overwrite().save(path)
    return path


def load_model(path: str):
    spark = SparkSession.active()
    try:
        spark.read.text(f"{path}/metadata").schema
    except AnalysisException:
        return LinearFit.load(spark, path)
    return PipelineModel.load(path)
