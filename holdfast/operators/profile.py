"""Profiling of a raw table. Each report is one aggregate over the needed columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from holdfast.functions import scalars as fn


def _long(row: DataFrame, cols: Sequence[str], name: str, value: str) -> DataFrame:
    """One aggregate row as one row per column."""
    return row.unpivot([], list(cols), name, value)


def column_profile(df: DataFrame) -> DataFrame:
    """position, column, type, non-null count and table size, one row per column."""
    rows = F.count(F.lit(1)).alias("__rows")
    counts = df.agg(rows, *[F.count(F.col(c)).alias(c) for c in df.columns])
    long = counts.unpivot(["__rows"], df.columns, "column_name", "non_null")
    names = F.array(*[F.lit(c) for c in df.columns])
    types = F.array(*[F.lit(f.dataType.simpleString()) for f in df.schema.fields])
    position = F.array_position(names, F.col("column_name")).cast("int")
    return long.select(
        position.alias("position"), "column_name", F.get(types, position - 1).alias("data_type"),
        "non_null", F.col("__rows").alias("n_rows"),
    )


def table_shape(df: DataFrame) -> DataFrame:
    """Row and column count."""
    return df.agg(F.count(F.lit(1)).alias("n_rows")).withColumn("n_columns", F.lit(len(df.columns)))


def first_rows(df: DataFrame, order_by: Sequence[str], n: int = 5) -> DataFrame:
    """The first n rows in a stated order (a table in Spark has none of its own)."""
    return df.orderBy(*order_by).limit(n)


def missing_counts(df: DataFrame) -> DataFrame:
    """Null (or NaN) count of every column that has any."""

    def missing(field: T.StructField):
        c = F.col(field.name)
        if isinstance(field.dataType, (T.DoubleType, T.FloatType)):
            return F.count_if(c.isNull() | F.isnan(c))
        return F.count_if(c.isNull())

    counts = df.agg(*[missing(f).alias(f.name) for f in df.schema.fields])
    return _long(counts, df.columns, "column_name", "n_missing").where("n_missing > 0")


def blank_counts(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Count of white-space-only texts per string column."""
    cols = list(cols or [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)])
    counts = df.agg(*[F.count_if(fn.blank(c)).alias(c) for c in cols])
    return _long(counts, cols, "column_name", "n_blank")


def value_counts(df: DataFrame, col: str) -> DataFrame:
    """Count and percent of each non-null value, most frequent first, ties by value."""
    counts = df.where(F.col(col).isNotNull()).groupBy(F.col(col).alias("value")).agg(
        F.count(F.lit(1)).alias("n")
    )
    total = counts.agg(F.sum("n")).scalar()
    share = F.col("n").cast("double") / total.cast("double") * F.lit(100.0)
    return counts.withColumn("percent", share).orderBy(F.desc("n"), "value")


def positive_rate(df: DataFrame, label: str = "label") -> DataFrame:
    """Row count, positives and their share."""
    return df.agg(
        F.count(label).alias("n"), F.sum(F.col(label).cast("long")).alias("n_positive"),
        F.avg(F.col(label).cast("double")).alias("positive_rate"),
    )
