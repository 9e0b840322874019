"""Global positions and hash-ordered cut-offs without a single-task sort."""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siteworks.operators.joins import measured
from siteworks.session import materialize


#: Rows of a hash prefix, about, that are sorted in one task.
PREFIX_ROWS = 4096


def ordered_positions(df: DataFrame, order: Sequence[str], name: str = "position") -> DataFrame:
    """Add 1..n in the order of ``order``, which must identify a row.

    Rows are range-partitioned, so equal-sized slices are sorted in parallel;
    only one count per slice meets in a single place. The slices are
    checkpointed because both the counts and the rows must see the same ones.
    """
    # monotonically_increasing_id is (partition id << 33) + place within the sorted partition.
    sliced = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("mark", F.monotonically_increasing_id())
    slices = materialize(sliced)
    slice_of = F.shiftright("mark", 33).alias("slice")
    before = Window.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        slices.groupBy(slice_of)
        .agg(F.count("*").alias("rows"))
        .select("slice", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("start"))
    )
    # One row per slice: at most the number of shuffle partitions.
    place = F.col("mark").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return (
        slices.withColumn("slice", F.shiftright("mark", 33))
        .join(F.broadcast(starts), "slice")
        .withColumn(name, (F.col("start") + place).cast("bigint"))
        .drop("slice", "mark", "start")
    )


def running_totals(df: DataFrame, order: Sequence[str], totals: Mapping[str, str]) -> DataFrame:
    """Running sums along ``order`` (which must identify a row): ``{new: source}``."""
    slices = materialize(df.repartitionByRange(*order).withColumn("slice", F.spark_partition_id()))
    before = Window.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy("slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    starts = (
        slices.groupBy("slice")
        .agg(*[F.sum(src).alias(f"sum_{new}") for new, src in totals.items()])
        .select(
            "slice",
            *[F.coalesce(F.sum(f"sum_{new}").over(before), F.lit(0)).alias(f"start_{new}") for new in totals],
        )
    )
    out = slices
    for new, src in totals.items():
        out = out.withColumn(f"part_{new}", F.sum(src).over(upto))
    out = out.join(starts, "slice")
    for new in totals:
        out = out.withColumn(new, F.col(f"start_{new}") + F.col(f"part_{new}"))
    return out.drop("slice", *[f"{p}_{new}" for new in totals for p in ("start", "part")])


def row_hash(key: Column, seed: int | Column) -> Column:
    """Portable row hash: md5 of ``key-seed`` as hex text."""
    seed_text = F.lit(str(seed)) if isinstance(seed, int) else seed.cast("string")
    return F.md5(F.concat(key.cast("string"), F.lit("-"), seed_text))


def hash_cutoffs(
    hashed: DataFrame,
    strata: Sequence[str],
    cuts: Sequence[Callable[[Column], Column]],
    hash_column: str = "h",
) -> DataFrame:
    """For each stratum, the hash of the row ranked ``cut(n)``, for several cuts.

    Returns ``strata, n, cutoffs``: an array with one text per cut, empty when the
    cut is 0. A stratum may hold any share of the rows: counts per hash prefix
    find the prefix each cut falls in, and only rows of those prefixes (some
    thousand each: the prefix is longer the more rows there are) are ever sorted.
    """
    strata = list(strata)
    digits = max(3, math.ceil(math.log(max(1, hashed.count()) / PREFIX_ROWS, 16)))
    prefixed = hashed.select(*strata, hash_column, F.substring(hash_column, 1, digits).alias("prefix"))
    counts = materialize(prefixed.groupBy(*strata, "prefix").agg(F.count("*").alias("rows")))
    by_prefix = Window.partitionBy(*strata).orderBy("prefix")
    spans = counts.withColumn(
        "upto", F.sum("rows").over(by_prefix.rowsBetween(Window.unboundedPreceding, 0))
    ).withColumn("n", F.sum("rows").over(Window.partitionBy(*strata)))
    wanted = F.array(
        *[F.struct(F.lit(j).alias("cut"), cut(F.col("n")).cast("bigint").alias("rank")) for j, cut in enumerate(cuts)]
    )
    picked = (
        spans.withColumn("want", F.explode(wanted))
        .where((F.col("want.rank") <= F.col("upto")) & (F.col("want.rank") > F.col("upto") - F.col("rows")))
        .select(*strata, "prefix", F.col("want.cut").alias("cut"), (F.col("want.rank") - F.col("upto") + F.col("rows")).alias("nth"))
    )
    nth = F.row_number().over(Window.partitionBy(*strata, "prefix", "cut").orderBy(hash_column))
    found = (
        prefixed.join(measured(picked), [*strata, "prefix"])
        .withColumn("place", nth)
        .where(F.col("place") == F.col("nth"))
        .groupBy(*strata)
        .agg(F.map_from_entries(F.collect_list(F.struct("cut", hash_column))).alias("found"))
    )
    sizes = counts.groupBy(*strata).agg(F.sum("rows").alias("n"))
    cutoffs = F.array(*[F.coalesce(F.col("found")[j], F.lit("")) for j in range(len(cuts))])
    return sizes.join(found, strata, "left").select(*strata, "n", cutoffs.alias("cutoffs"))


def sample_rows(df: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """n rows with the smallest hashes: a fixed sample, kept as a top-n per task."""
    return df.orderBy(row_hash(F.col(key), seed), F.col(key)).limit(n)


def sample_fraction(df: DataFrame, key: str, fraction: float, seed: int) -> DataFrame:
    """A fixed sample of about the given share, decided row by row."""
    place = F.conv(F.substring(row_hash(F.col(key), seed), 1, 8), 16, 10).cast("bigint")
    return df.where(place < F.lit(int(fraction * 2**32)))
