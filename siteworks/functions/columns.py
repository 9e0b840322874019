"""Cleaning, date, age and numeric column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Reference day and year, and the bad latitude constant.
REFERENCE_DATE = "2013-12-03"
REFERENCE_YEAR = 2013
BAD_LATITUDE = -2e-08


def zero_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(0))


def repair_value(c: Column, bad: float, good: float) -> Column:
    return F.when(c == F.lit(bad), F.lit(good)).otherwise(c)


def missing_flag(c: Column) -> Column:
    return c.isNull().cast("int")


def null_or_zero(c: Column) -> Column:
    return c.isNull() | (c == 0)


def has_coordinates(lat: Column, lon: Column) -> Column:
    """Neither null nor the zero sentinel; never null itself."""
    return F.coalesce((lat != 0) & (lon != 0), F.lit(False))


def bool_to_int(c: Column) -> Column:
    return F.coalesce(c.cast("int"), F.lit(0))


def safe_ratio(num: Column, den: Column) -> Column:
    """Null instead of an error or infinity when the divisor is zero."""
    return F.try_divide(num.cast("double"), den.cast("double"))


def contains_ci(c: Column, text: str) -> Column:
    return F.coalesce(F.lower(c).contains(text.lower()), F.lit(False))


def all_present(columns: Sequence[str]) -> Column:
    out = F.lit(True)
    for name in columns:
        out = out & F.col(name).isNotNull()
    return out


def days_since(c: Column, reference: str = REFERENCE_DATE) -> Column:
    return F.datediff(F.to_date(F.lit(reference)), c)


def is_dry_season(c: Column) -> Column:
    """June to September."""
    return F.month(c).between(6, 9).cast("int")


def age_at_reference(year: Column) -> Column:
    return F.lit(REFERENCE_YEAR) - year


def age_when_recorded(recorded: Column, construction_year: Column) -> Column:
    """Years between building (0 = unknown) and recording; negative becomes null."""
    age = F.year(recorded) - zero_to_null(construction_year)
    return F.when(age >= 0, age)


def years_in_service(recorded: Column, construction_year: Column) -> Column:
    years = F.year(recorded) - construction_year
    return F.when(years.isNotNull(), F.greatest(F.lit(0), F.least(F.lit(50), years)))


def age_bin(years: Column) -> Column:
    """Right-closed bins (-1, 5], (5, 15], (15, 30], (30, 100]."""
    return (
        F.when((years > -1) & (years <= 5), "new")
        .when((years > 5) & (years <= 15), "medium")
        .when((years > 15) & (years <= 30), "old")
        .when((years > 30) & (years <= 100), "very_old")
    )


def log_population(c: Column) -> Column:
    return F.log1p(F.coalesce(zero_to_null(c), F.lit(1)).cast("double"))


def minmax(c: Column, low: Column, high: Column) -> Column:
    return F.try_divide((c - low).cast("double"), (high - low).cast("double"))


def recency_weight(days: Column, low: Column, high: Column) -> Column:
    """exp(1 - scaled age) / e, so the newest row weighs one."""
    return F.exp(F.lit(1.0) - minmax(days, low, high)) / F.exp(F.lit(1.0))
