"""Group statistics and their joins back to rows.

Statistics combine on the map side, so a group with a third of the rows sends
one partial row per task. For the join back the statistics are stored once and
broadcast only if their counted rows allow it, so the rows need not be shuffled.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siteworks.functions.geo import planar_distance
from siteworks.operators.joins import measured
from siteworks.operators.quantiles import exact_median, exact_medians, exact_quantiles
from siteworks.session import materialize

POSITIVE = "functional"
REPAIR = "functional needs repair"


def share_of(label: Column, value: str) -> Column:
    """Share of rows with the value; a null label counts as another value."""
    return F.avg(F.when(label == value, 1.0).otherwise(0.0))


def join_back(df: DataFrame, stats: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.join(measured(stats), list(keys), "left")


def group_rates(df: DataFrame, key: str, label: str, rates: Mapping[str, str]) -> DataFrame:
    """One row per non-null key with the share of each label in ``{name: label}``."""
    return (
        df.where(F.col(key).isNotNull())
        .groupBy(key)
        .agg(*[share_of(F.col(label), value).alias(name) for name, value in rates.items()])
    )


def mean_and_std(df: DataFrame, key: str, columns: Sequence[str], prefix: str) -> DataFrame:
    """Mean and sample deviation, named ``<prefix>_<column>_<mean|std>``."""
    aggs = []
    for name in columns:
        aggs.append(F.avg(name).alias(f"{prefix}_{name}_mean"))
        aggs.append(F.stddev_samp(name).alias(f"{prefix}_{name}_std"))
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(*aggs)


def ward_statistics(reference: DataFrame, prefix: str = "ward") -> DataFrame:
    """Located rows and functional share per ward."""
    return (
        reference.where(F.col("ward").isNotNull())
        .groupBy("ward")
        .agg(
            F.count("latitude").alias(f"{prefix}_site_count"),
            share_of(F.col("status_group"), POSITIVE).alias(f"{prefix}_functional_ratio"),
            F.count("*").alias(f"{prefix}_rows"),
        )
    )


def add_ward_statistics(df: DataFrame, reference: DataFrame | None = None) -> DataFrame:
    """Ward count and rate; without a reference they come from ``df`` itself.

    Gaps take the median count (of the rows, or of the reference's wards) and 0.5.
    """
    # Stored: the median is taken from the wards, each weighing as many as its rows, not from the rows again.
    stats = materialize(ward_statistics(df if reference is None else reference))
    weight = F.col("ward_rows") if reference is None else F.lit(1)
    middle = weighted_median(stats, "ward_site_count", weight).scalar()
    joined = join_back(df, stats.drop("ward_rows"), ["ward"])
    return joined.withColumn(
        "ward_site_count", F.coalesce(F.col("ward_site_count").cast("double"), middle)
    ).withColumn("ward_functional_ratio", F.coalesce("ward_functional_ratio", F.lit(0.5)))


def weighted_median(groups: DataFrame, count: str, weight: Column) -> DataFrame:
    """One row: the median of a column of group sizes, every group counted ``weight`` times.

    Different sizes of groups add up to no more than the rows, so among n rows there are at most
    about sqrt(2 n) of them: few enough to be ordered in one place.
    """
    sizes = groups.groupBy(F.col(count).cast("double").alias("group_size")).agg(F.sum(weight).alias("times")).where("group_size is not null")
    order = Window.orderBy("group_size")
    placed = sizes.withColumns({
        "upto": F.sum("times").over(order.rowsBetween(Window.unboundedPreceding, 0)),
        "n": F.sum("times").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)),
    })
    holds = lambda rank: (rank >= F.col("upto") - F.col("times")) & (rank < F.col("upto"))
    low, high = F.floor((F.col("n") - 1) / 2), F.ceil((F.col("n") - 1) / 2)
    return placed.agg(((F.max(F.when(holds(low), F.col("group_size"))) + F.max(F.when(holds(high), F.col("group_size")))) / 2).alias("median"))


def own_row_excluded_rate(df: DataFrame, key: str, label: str, value: str, name: str) -> DataFrame:
    """Share of a label among the *other* rows of the group; null for a lone row.

    Keeps a row's own label out of its feature, which the plain group rate does not.
    """
    hit = F.when(F.col(label) == value, 1).otherwise(0)
    sums = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.sum(hit).alias("group_hits"), F.count("*").alias("group_rows"))
    others = F.try_divide((F.col("group_hits") - hit).cast("double"), (F.col("group_rows") - 1).cast("double"))
    return join_back(df, sums, [key]).withColumn(name, others).drop("group_hits", "group_rows")


def distinct_counts(df: DataFrame, keys: Sequence[str], columns: Sequence[str], approximate: bool = False) -> DataFrame:
    """Distinct values per group, exact or as a mergeable estimate, named ``n_<column>``."""
    count = F.approx_count_distinct if approximate else F.count_distinct
    return df.groupBy(*keys).agg(*[count(c).alias(f"n_{c}") for c in columns])


def first_per_key(df: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """Value of the first row by ``order``, per non-null key."""
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(F.min_by(value, order).alias(value))


def pair_shares(df: DataFrame, left: str, right: str, name: str) -> DataFrame:
    """Rows per pair of values, relative to the most frequent pair."""
    pairs = df.where(F.col(left).isNotNull() & F.col(right).isNotNull()).groupBy(left, right).agg(F.count("*").alias("pair_rows"))
    largest = pairs.agg(F.max("pair_rows").alias("top")).scalar()
    return pairs.withColumn(name, F.col("pair_rows").cast("double") / largest)


def value_counts(df: DataFrame, column: str) -> DataFrame:
    counts = df.groupBy(column).agg(F.count("*").alias("n"))
    total = df.agg(F.count("*").alias("total")).scalar()
    return counts.withColumn("share", F.col("n").cast("double") / total)


def centroid_distance(df: DataFrame, key: str) -> DataFrame:
    """Planar distance of each located row to the mean point of its group."""
    centres = df.groupBy(key).agg(F.avg("latitude").alias("centre_lat"), F.avg("longitude").alias("centre_lon"))
    distance = planar_distance(F.col("latitude"), F.col("longitude"), F.col("centre_lat"), F.col("centre_lon"))
    return join_back(df, centres, [key]).withColumn(f"{key}_centroid_distance", distance)


def geographic_outliers(df: DataFrame, key: str, deviations: float = 2.0) -> DataFrame:
    """Flag rows farther from the group's median point than mean + 2 sample deviations."""
    middles = exact_medians(df, ["latitude", "longitude"], [key]).withColumnsRenamed(
        {"latitude": "median_lat", "longitude": "median_lon"}
    )
    near = join_back(df, middles, [key]).withColumn(
        "median_distance",
        planar_distance(F.col("latitude"), F.col("longitude"), F.col("median_lat"), F.col("median_lon")),
    )
    limits = near.groupBy(key).agg(
        (F.avg("median_distance") + F.lit(deviations) * F.stddev_samp("median_distance")).alias("limit")
    )
    flag = F.coalesce(F.col("median_distance") > F.col("limit"), F.lit(False)).cast("int")
    return join_back(near, limits, [key]).withColumn("is_geographic_outlier", flag)


def above_quantile_flag(df: DataFrame, column: str, p: float, name: str) -> DataFrame:
    limit = exact_quantiles(df, column, {"q": p}).select("q").scalar()
    return df.withColumn(name, F.coalesce(F.col(column) > limit, F.lit(False)).cast("int"))


def anova_f(df: DataFrame, features: Sequence[str], label: str) -> DataFrame:
    """One-way F statistic per feature from counts, means and variances per class."""
    long = (
        df.where(F.col(label).isNotNull())
        .select(label, *[F.col(f).cast("double").alias(f) for f in features])
        .unpivot([label], list(features), "feature", "value")
        .where(F.col("value").isNotNull())
    )
    per_class = long.groupBy("feature", label).agg(
        F.count("*").alias("n"), F.avg("value").alias("mean"), F.var_pop("value").alias("var")
    )
    overall = per_class.groupBy("feature").agg(
        (F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("grand"),
        F.sum("n").alias("total"),
        F.count("*").alias("classes"),
    )
    return (
        per_class.join(overall, "feature")
        .groupBy("feature")
        .agg(
            F.sum(F.col("n") * F.pow(F.col("mean") - F.col("grand"), F.lit(2.0))).alias("between"),
            F.sum(F.col("n") * F.col("var")).alias("within"),
            F.max("total").alias("total"),
            F.max("classes").alias("classes"),
        )
        .select(
            "feature",
            F.try_divide(
                F.col("between") / (F.col("classes") - 1), F.col("within") / (F.col("total") - F.col("classes"))
            ).alias("f_value"),
        )
    )


def numeric_summary(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row per column: min, max, mean, sample deviation. One pass, no shuffle of rows."""
    aggs = []
    for name in columns:
        c = F.col(name).cast("double")
        aggs.append(
            F.struct(
                F.lit(name).alias("column_name"),
                F.min(c).alias("min_value"),
                F.max(c).alias("max_value"),
                F.avg(c).alias("mean_value"),
                F.stddev_samp(c).alias("std_value"),
            )
        )
    return df.agg(F.array(*aggs).alias("stats")).select(F.inline("stats"))
