"""Delimited files with messy missing-value markers."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabkit.operators.columns import clean_names as _clean_names

NA_TOKENS = ("N/A", "NA", "NaN", "", ".")


def null_tokens(c, tokens):
    """NULL where the trimmed text is one of the tokens."""
    return F.when(~F.trim(c).isin(list(tokens)), F.trim(c))


def infer_schema(text: DataFrame) -> T.StructType:
    """Narrowest of long, double, timestamp-free string per column, in one pass over the rows."""
    if not text.columns:
        return T.StructType([])
    checks = []
    for c in text.columns:
        col = F.col(f"`{c}`")
        filled = F.count(col)
        checks += [
            (F.count(col.try_cast("bigint")) == filled).alias(f"{c}|bigint"),
            (F.count(col.try_cast("double")) == filled).alias(f"{c}|double"),
            F.coalesce(F.bool_and(F.lower(col).isin("true", "false")), F.lit(False)).alias(f"{c}|boolean"),
            (filled > 0).alias(f"{c}|any"),
        ]
    row = text.agg(*checks).first()
    fields = []
    for c in text.columns:
        if not row[f"{c}|any"]:
            kind = T.StringType()
        elif row[f"{c}|boolean"]:
            kind = T.BooleanType()
        elif row[f"{c}|bigint"]:
            kind = T.LongType()
        elif row[f"{c}|double"]:
            kind = T.DoubleType()
        else:
            kind = T.StringType()
        fields.append(T.StructField(c, kind, True))
    return T.StructType(fields)


def read_table(spark: SparkSession, path: str, na_tokens=NA_TOKENS, schema: T.StructType | None = None,
               clean_names: bool = False, split_camel: bool = True) -> DataFrame:
    """CSV with header: read as text, null the tokens, then type.

    With a declared schema only those columns are read and the scan is a single lazy
    pass. Without one the types are found by one aggregate over all columns.
    """
    raw = spark.read.option("header", True).option("quote", '"').option("escape", '"').csv(path)
    if clean_names:
        raw = _clean_names(raw, split_camel=split_camel)
    text = raw.select([null_tokens(F.col(f"`{c}`"), na_tokens).alias(c) for c in raw.columns])
    if schema is None:
        schema = infer_schema(text)
    out = []
    for field in schema.fields:
        c = F.col(f"`{field.name}`").try_cast(field.dataType)
        if isinstance(field.dataType, (T.DoubleType, T.FloatType)):
            c = F.when(~F.isnan(c), c)
        out.append(c.alias(field.name))
    return text.select(out)


def list_files(spark: SparkSession, directory: str, suffix: str = ".csv") -> dict[str, str]:
    """Name to path of the files in a folder, on any file system Spark can reach."""
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(directory)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    paths = sorted(s.getPath().toString() for s in fs.listStatus(root))
    return {os.path.basename(p)[: -len(suffix)]: p for p in paths if p.endswith(suffix)}


def read_directory(spark: SparkSession, directory: str, na_tokens=NA_TOKENS, schemas: dict | None = None,
                   clean_names: bool = True, date_columns=("date",)) -> dict[str, DataFrame]:
    """Every ``*.csv`` of a folder as a named table, with its date column parsed."""
    schemas = schemas or {}
    return {
        name: parse_dates(
            read_table(spark, path, na_tokens, schemas.get(name), clean_names), date_columns
        )
        for name, path in list_files(spark, directory).items()
    }


def parse_dates(df: DataFrame, cols=("date",), fmt: str | None = None) -> DataFrame:
    """Parse the named text columns, where present, to timestamps; unreadable text becomes NULL."""
    present = [c for c in cols if c in df.columns]
    if not present:
        return df
    args = (F.lit(fmt),) if fmt else ()
    return df.withColumns({c: F.try_to_timestamp(F.col(c).cast("string"), *args) for c in present})
