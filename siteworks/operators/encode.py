"""Category codes from one dictionary, with explicit rules for unseen values."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siteworks.operators.joins import BROADCAST_BYTES, hinted, measured
from siteworks.operators.ordering import ordered_positions
from siteworks.session import materialize


def as_category(df: DataFrame, columns: Sequence[str], null_text: str = "nan") -> DataFrame:
    """Columns as text: booleans as True / False, null as ``null_text``."""
    kinds = dict(df.dtypes)
    out = {}
    for name in columns:
        text = F.col(name).cast("string")
        if kinds[name] == "boolean":
            text = F.initcap(text)
        out[name] = F.coalesce(text, F.lit(null_text))
    return df.withColumns(out)


def fit_dictionary(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``column_name, value, code``: rank of each value among the column's sorted values.

    All columns are fitted in one pass over distinct (column, value) pairs; ranks
    come from range-partitioned positions, so cardinality is not limited.
    """
    pairs = df.select(*columns).unpivot([], list(columns), "column_name", "value").distinct()
    placed = ordered_positions(pairs, ["column_name", "value"])
    starts = placed.groupBy("column_name").agg(F.min("position").alias("start"))
    # One start per column.
    return placed.join(F.broadcast(starts), "column_name").select(
        "column_name", "value", (F.col("position") - F.col("start")).cast("int").alias("code")
    )


def apply_dictionary(
    df: DataFrame, dictionary: DataFrame, columns: Mapping[str, str], unseen: int | None = None
) -> DataFrame:
    """Add code columns ``{source: target}``; values not in the dictionary get ``unseen``."""
    stored = materialize(dictionary.where(F.col("column_name").isin(list(columns))))
    # One row per column: values and the bytes of their texts, with eight for the code and eight for the length.
    width = F.sum(F.coalesce(F.octet_length("value"), F.lit(0)) + 16).alias("bytes")
    sizes = {r.column_name: (r["n"], r["bytes"]) for r in stored.groupBy("column_name").agg(F.count("*").alias("n"), width).collect()}
    out = df
    for source, target in columns.items():
        codes = stored.where(F.col("column_name") == source).select(
            F.col("value").alias(source), F.col("code").alias(target)
        )
        # Only a dictionary that was found small, in rows and bytes, is broadcast; a larger one is an ordinary side.
        rows, size = sizes.get(source, (0, 0))
        out = out.join(hinted(codes, rows) if size <= BROADCAST_BYTES else codes, source, "left")
        if unseen is not None:
            out = out.withColumn(target, F.coalesce(target, F.lit(unseen)))
    return out


def decode(df: DataFrame, dictionary: DataFrame, column: str, code: str, name: str) -> DataFrame:
    """Values back from their codes."""
    values = dictionary.where(F.col("column_name") == column).select(F.col("code").alias(code), F.col("value").alias(name))
    return df.join(measured(values), code, "left")


def apply_with_literal(df: DataFrame, dictionary: DataFrame, source: str, target: str, literal: str = "unknown") -> DataFrame:
    """Unseen values take the code of ``literal`` if the dictionary has it, else -1."""
    of_column = dictionary.where(F.col("column_name") == source)
    fallback = of_column.where(F.col("value") == literal).agg(F.max("code").alias("code")).scalar()
    coded = apply_dictionary(df, dictionary, {source: target})
    return coded.withColumn(target, F.coalesce(F.col(target), fallback, F.lit(-1)))


def unseen_values(df: DataFrame, dictionary: DataFrame, source: str) -> DataFrame:
    known = dictionary.where(F.col("column_name") == source).select(F.col("value").alias(source))
    return df.select(source).distinct().join(known, source, "left_anti")


def extend_dictionary(dictionary: DataFrame, df: DataFrame, source: str) -> DataFrame:
    """Known values keep their codes; unseen ones follow in sorted order."""
    of_column = dictionary.where(F.col("column_name") == source)
    last = of_column.agg(F.coalesce(F.max("code"), F.lit(-1)).alias("last")).scalar()
    fresh = ordered_positions(unseen_values(df, dictionary, source), [source])
    added = fresh.select(
        F.lit(source).alias("column_name"), F.col(source).alias("value"), (last + F.col("position")).cast("int").alias("code")
    )
    return of_column.unionByName(added)


def label_encode(df: DataFrame, columns: Sequence[str], suffix: str = "_encoded", keep: Sequence[str] = ("id",)) -> DataFrame:
    """Fit and apply on the same rows; the columns in ``keep`` come along, so no join by id is needed."""
    return add_codes(df.select(*dict.fromkeys([*keep, *columns])), columns, suffix=suffix).select(*keep, *[c + suffix for c in columns])


def add_codes(
    df: DataFrame, columns: Sequence[str], fit_on: DataFrame | None = None, unseen: int | None = None, suffix: str = "_encoded"
) -> DataFrame:
    """``df`` with a code column for each of ``columns``, which stay as they are."""
    text = {c: f"{c}{suffix}_text" for c in columns}

    def as_text(rows: DataFrame) -> DataFrame:
        return as_category(rows.withColumns({name: F.col(c) for c, name in text.items()}), list(text.values()))

    source = as_text((df if fit_on is None else fit_on).select(*columns))
    dictionary = fit_dictionary(source, list(text.values()))
    coded = apply_dictionary(as_text(df), dictionary, {name: c + suffix for c, name in text.items()}, unseen)
    return coded.drop(*text.values())


def standardize(df: DataFrame, columns: Sequence[str], fit_on: DataFrame | None = None) -> DataFrame:
    """(x - mean) / population deviation of the fitted rows; null where it is 0."""
    source = df if fit_on is None else fit_on
    stats = source.agg(
        F.struct(
            *[F.avg(c).alias(f"mean_{c}") for c in columns], *[F.stddev_pop(c).alias(f"std_{c}") for c in columns]
        ).alias("s")
    ).scalar()
    return df.withColumns(
        {f"{c}_scaled": F.try_divide(F.col(c) - stats[f"mean_{c}"], stats[f"std_{c}"]) for c in columns}
    )
