"""Column audits: completeness, cardinality, types."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def completeness(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Present and missing values per column, in one aggregation."""
    stats = [
        F.struct(
            F.lit(name).alias("column_name"),
            F.count(name).alias("present"),
            F.sum(F.col(name).isNull().cast("bigint")).alias("missing"),
        )
        for name in columns
    ]
    return df.agg(F.array(*stats).alias("stats")).select(F.inline("stats"))


def distinct_per_column(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Exact distinct non-null values per column.

    Values are made unique by (column, value) first, so neither a wide column
    nor a frequent value concentrates in one task.
    """
    long = df.select(*[F.col(c).cast("string").alias(c) for c in columns]).unpivot([], list(columns), "column_name", "value")
    counted = long.where("value is not null").distinct().groupBy("column_name").agg(F.count("*").alias("n_distinct"))
    names = df.sparkSession.createDataFrame([(c,) for c in columns], "column_name string")
    return names.join(counted, "column_name", "left").withColumn("n_distinct", F.coalesce("n_distinct", F.lit(0)))


def low_cardinality_columns(df: DataFrame, columns: Sequence[str], limit: int) -> list[str]:
    """Names of the columns with at most ``limit`` values (one row per column is read)."""
    kept = {r.column_name for r in distinct_per_column(df, columns).where(F.col("n_distinct") <= limit).collect()}
    return [c for c in columns if c in kept]


def few_valued_columns(df: DataFrame, columns: Sequence[str], limit: int = 3) -> DataFrame:
    """Text columns with at most ``limit`` values, and those values: hidden booleans."""
    long = df.select(*[F.col(c).cast("string").alias(c) for c in columns]).unpivot([], list(columns), "column_name", "value")
    distinct = long.where("value is not null").distinct()
    few = distinct.groupBy("column_name").agg(F.count("*").alias("n_distinct")).where(F.col("n_distinct") <= limit)
    return (
        distinct.join(few, "column_name")
        .groupBy("column_name", "n_distinct")
        .agg(F.array_join(F.array_sort(F.collect_list("value")), "|").alias("distinct_values"))
    )


def columns_of_type(df: DataFrame, *types: str) -> list[str]:
    return [name for name, kind in df.dtypes if kind in types]


def columns_present(df: DataFrame, wanted: Sequence[str]) -> list[str]:
    """Schema guard: the wanted columns that exist, in the wanted order."""
    have = set(df.columns)
    return [c for c in wanted if c in have]
