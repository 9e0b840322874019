"""Equi-join helpers: measured broadcasts, semi / anti work lists, fallbacks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siteworks.session import materialize_sized

# A side is broadcast only after it was stored and found to hold at most this many rows and bytes.
BROADCAST_ROWS = 300_000
BROADCAST_BYTES = 64 << 20


def hinted(stored: DataFrame, rows: int, most: int | None = None) -> DataFrame:
    """Mark a side for broadcast only if its counted rows allow."""
    return F.broadcast(stored) if rows <= (BROADCAST_ROWS if most is None else most) else stored


def measured(side: DataFrame, most: int | None = None) -> DataFrame:
    """Store a join side once and broadcast it only if it proves small.

    Beyond the bound it stays an ordinary side: Spark shuffles both inputs and
    adaptive execution splits the keys that hold too many rows.
    """
    stored, rows, size = materialize_sized(side)
    return hinted(stored, rows, most) if size <= BROADCAST_BYTES else stored


def natural_join(left: DataFrame, right: DataFrame, how: str = "inner") -> DataFrame:
    """Join on all shared column names."""
    shared = [c for c in left.columns if c in set(right.columns)]
    return left.join(right, shared, how)


def not_yet_done(source: DataFrame, done: DataFrame, key: str = "id") -> DataFrame:
    return source.join(done.select(key), key, "left_anti")


def only_listed(source: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    return source.join(ids.select(key), key, "left_semi")


def lookup(df: DataFrame, dictionary: DataFrame, keys: Sequence[str], value: str, default) -> DataFrame:
    """Dictionary value per row, ``default`` where the keys are unknown."""
    side = measured(dictionary.select(*keys, value))
    return df.join(side, list(keys), "left").withColumn(value, F.coalesce(value, F.lit(default)))


def map_back(df: DataFrame, subset: DataFrame, key: str, defaults: dict[str, object]) -> DataFrame:
    """Results known for some rows only, on all rows, with a default per column."""
    joined = df.join(subset, key, "left")
    return joined.withColumns({name: F.coalesce(F.col(name), value) for name, value in defaults.items()})
