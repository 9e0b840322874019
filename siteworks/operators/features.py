"""Feature tables for models, built from the single-purpose operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siteworks.functions import columns as fx
from siteworks.functions import text
from siteworks.functions.ratings import RATINGS, all_ratings
from siteworks.operators import encode, groups, spatial
from siteworks.operators.joins import map_back
from siteworks.operators.profile import columns_present

ZERO_IS_MISSING = ["longitude", "latitude", "gps_height", "population"]
CATEGORIES = ["quantity", "water_quality", "management", "extraction_type", "payment", "source", "basin", "region", "ward"]
NUMBERS = ["amount_tsh", "gps_height", "longitude", "latitude", "population", "year_recorded", "month_recorded",
           "days_since_recorded", "asset_age", "construction_year_missing", "funder_length", "installer_length",
           "scheme_name_length", *[f"{c}_missing" for c in ZERO_IS_MISSING]]
BASE = [*NUMBERS, *[f"{c}_encoded" for c in CATEGORIES]]
GEO = ["ward_site_count", "ward_functional_ratio", "neighbor_functional_ratio"]
INTERACTIONS = ["quantity_quality_interact", "ward_age_interact", "neighbor_time_interact"]
RATED = [f"rating_{r}" for r in RATINGS]


# The two curated feature lists, by role.
FEATURE_SETS = {
    "lean": {
        "numbers": ["amount_tsh", "longitude", "latitude", "gps_height", "population"],
        "holes": ["longitude", "latitude", "gps_height"],
        "categories": ["quantity", "waterpoint_type", "payment", "water_quality", "extraction_type"],
    },
    "fast": {
        "numbers": ["amount_tsh", "gps_height", "longitude", "latitude", "population"],
        "holes": ["longitude", "latitude", "gps_height", "population"],
        "categories": ["quantity", "quantity_group", "waterpoint_type", "extraction_type", "management", "payment", "water_quality", "source_type"],
    },
}


def feature_set(df: DataFrame, name: str, fill: float = -1) -> DataFrame:
    """One curated list: numbers with flags for zeros, dates, age, category codes; gaps filled.

    Columns the table lacks are skipped when the plan is built.
    """
    roles = FEATURE_SETS[name]
    holes, categories = columns_present(df, roles["holes"]), columns_present(df, roles["categories"])
    rows = df
    for c in holes:
        rows = rows.withColumn(c, fx.zero_to_null(F.col(c))).withColumn(f"{c}_missing", fx.missing_flag(F.col(c)))
    numbers = rows.select(
        "id",
        *categories,
        *columns_present(df, roles["numbers"]),
        *[f"{c}_missing" for c in holes],
        F.year("date_recorded").alias("year_recorded"),
        fx.days_since(F.col("date_recorded")).alias("days_since_recorded"),
        fx.age_at_reference(F.col("construction_year")).alias("asset_age"),
    )
    return encode.add_codes(numbers, categories).drop(*categories).fillna(fill)


def add_columns(df: DataFrame) -> DataFrame:
    """Everything a row yields on its own: flags, dates, age, lengths, ratings."""
    out = df
    for c in ZERO_IS_MISSING:
        out = out.withColumn(c, fx.zero_to_null(F.col(c))).withColumn(f"{c}_missing", fx.missing_flag(F.col(c)))
    recorded = F.col("date_recorded")
    return out.select(
        "*",
        F.year(recorded).alias("year_recorded"),
        F.month(recorded).alias("month_recorded"),
        fx.days_since(recorded).alias("days_since_recorded"),
        fx.age_at_reference(F.col("construction_year")).alias("asset_age"),
        fx.missing_flag(F.col("construction_year")).alias("construction_year_missing"),
        *[text.text_length(F.col(c)).alias(f"{c}_length") for c in ("funder", "installer", "scheme_name")],
        *all_ratings("rating_"),
    )


def add_codes(df: DataFrame, fit_on: DataFrame | None = None, columns: list[str] = CATEGORIES) -> DataFrame:
    """Category codes of one dictionary; values the fitted rows lack become -1."""
    return encode.add_codes(df, columns, fit_on, unseen=-1)


def add_geo(df: DataFrame, reference: DataFrame | None = None, k: int = 10) -> DataFrame:
    """Ward statistics and the neighbours' functional share."""
    known = df if reference is None else reference
    rate = spatial.neighbor_rate(
        spatial.nearest_neighbors(df, k, reference), known, "status_group", groups.POSITIVE, "neighbor_functional_ratio"
    )
    wards = groups.add_ward_statistics(df, reference)
    return map_back(wards, rate, "id", {"neighbor_functional_ratio": F.lit(0.5)})


def add_interactions(df: DataFrame) -> DataFrame:
    return df.select(
        "*",
        (F.col("quantity_encoded") * F.col("water_quality_encoded")).alias("quantity_quality_interact"),
        (F.col("ward_functional_ratio") * F.col("asset_age")).alias("ward_age_interact"),
        (F.col("neighbor_functional_ratio") * F.col("days_since_recorded")).alias("neighbor_time_interact"),
    )


def full_features(df: DataFrame, reference: DataFrame | None = None) -> DataFrame:
    """Spatial, row, code and interaction features; fitted on ``reference`` if given."""
    return add_interactions(add_codes(add_columns(add_geo(df, reference)), reference))
