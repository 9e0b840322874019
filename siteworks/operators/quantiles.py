"""Exact quantiles, global or per group, for groups of any size."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siteworks.operators.joins import measured
from siteworks.operators.ordering import running_totals

# Half-width, as a share of the rows, of the band that is searched exactly.
BAND = 0.0005
# Rows of a band that one task may order.
BAND_ROWS = 1_000_000
SKETCH_ACCURACY = 10000


def exact_quantiles(df: DataFrame, value: str, probs: Mapping[str, float], keys: Sequence[str] = ()) -> DataFrame:
    """``keys`` plus one linearly interpolated quantile column per entry of ``probs``.

    The built-in exact percentile keeps every distinct value of a group in one
    task. Here a mergeable sketch proposes a narrow band of values around each
    wanted rank, exact counts per band tell which band holds it, and only that
    band's distinct values are ordered. The counts decide, so the result is exact
    whatever the sketch's error; the sketch only sets how many rows are sorted.
    """
    keys = list(keys)
    rows = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("v"))
    edges = sorted({max(0.0, p - BAND) for p in probs.values()} | {min(1.0, p + BAND) for p in probs.values()})
    sketch = rows.groupBy(*keys).agg(
        F.count("*").alias("n"), F.percentile_approx("v", edges, SKETCH_ACCURACY).alias("edges")
    )

    def band(edge) -> Column:
        place = F.lit(0)
        for i in range(len(edges)):
            place = place + (F.col("v") > edge(i)).cast("int") + (F.col("v") >= edge(i)).cast("int")
        return place

    if keys:
        near = measured(sketch.select(*keys, "edges"))
        banded = rows.join(near, keys).select(*keys, "v", band(lambda i: F.col("edges")[i]).alias("band"))
    else:
        # One short array: read it, so that the rows are compared with constants.
        found = sketch.first().edges
        banded = rows.select("v", band(lambda i: F.lit(found[i] if found else None)).alias("band"))
    by_band = Window.partitionBy(*keys).orderBy("band").rowsBetween(Window.unboundedPreceding, 0)
    spans = banded.groupBy(*keys, "band").agg(F.count("*").alias("rows")).withColumn("upto", F.sum("rows").over(by_band))
    spans = spans.withColumn("n", F.max("upto").over(Window.partitionBy(*keys)))
    first_rank = F.col("upto") - F.col("rows")
    needed = F.lit(False)
    for p in probs.values():
        low, high = _ranks(p)
        needed = needed | ((high >= first_rank) & (low < F.col("upto")))
    spans = measured(spans.where(needed).select(*keys, "band", first_rank.alias("start"), "n", "rows"))
    largest = spans.agg(F.max("rows")).first()[0] or 0
    distinct = banded.join(spans, [*keys, "band"]).groupBy(*keys, "band", "v", "start", "n").agg(F.count("*").alias("times"))
    if largest <= BAND_ROWS:
        by_value = Window.partitionBy(*keys, "band").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
        ranked = distinct.withColumn("upto", F.col("start") + F.sum("times").over(by_value))
    else:
        # A band that is too long for one task is summed over range-partitioned slices.
        summed = running_totals(distinct, [*keys, "band", "v"], {"overall": "times"})
        before = summed.groupBy(*keys, "band").agg(F.min(F.col("overall") - F.col("times")).alias("before"))
        ranked = summed.join(before, [*keys, "band"]).withColumn("upto", F.col("start") + F.col("overall") - F.col("before"))
    from_rank = F.col("upto") - F.col("times")
    ends = []
    for name, p in probs.items():
        low, high = _ranks(p)
        ends.append(F.max(F.when((low >= from_rank) & (low < F.col("upto")), F.col("v"))).alias(f"low_{name}"))
        ends.append(F.max(F.when((high >= from_rank) & (high < F.col("upto")), F.col("v"))).alias(f"high_{name}"))
    found = ranked.groupBy(*keys).agg(F.max("n").alias("n"), *ends)
    out = []
    for name, p in probs.items():
        low, _ = _ranks(p)
        share = F.lit(p) * (F.col("n") - 1) - low
        out.append((F.col(f"low_{name}") + (F.col(f"high_{name}") - F.col(f"low_{name}")) * share).alias(name))
    return found.select(*keys, *out)


def _ranks(p: float):
    """Zero-based ranks on both sides of quantile ``p`` of ``n`` values."""
    place = F.lit(p) * (F.col("n") - 1)
    return F.floor(place), F.ceil(place)


def exact_median(df: DataFrame, value: str, keys: Sequence[str] = (), name: str = "median") -> DataFrame:
    return exact_quantiles(df, value, {name: 0.5}, keys)


def exact_medians(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Medians of several columns in one go: one row per group, one column each, same names."""
    names = list(columns)
    long = df.select(*keys, *[F.col(c).cast("double").alias(c) for c in names]).unpivot(list(keys), names, "column_name", "value")
    medians = exact_quantiles(long, "value", {"median": 0.5}, [*keys, "column_name"])
    return medians.groupBy(*keys).agg(*[F.max(F.when(F.col("column_name") == c, F.col("median"))).alias(c) for c in names])
