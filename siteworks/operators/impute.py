"""Filling gaps with statistics of fitted rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siteworks.operators.quantiles import exact_medians


def impute(df: DataFrame, columns: Sequence[str], how: str = "median", fit_on: DataFrame | None = None) -> DataFrame:
    """Null becomes the exact median or the mean of the fitted rows, as a double."""
    source = df if fit_on is None else fit_on
    if how == "mean":
        fills = source.agg(*[F.avg(c).alias(c) for c in columns])
    elif how == "median":
        fills = exact_medians(source, columns)
    else:
        raise ValueError(f"how must be 'median' or 'mean', not {how!r}")
    filled = fills.select(F.struct(*columns).alias("fills")).scalar()
    return df.withColumns({c: F.coalesce(F.col(c).cast("double"), filled[c]) for c in columns})
