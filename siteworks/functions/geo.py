"""Great-circle and planar distance expressions, all in JVM code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS_KM = 6371.0


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    half_lat = F.sin(F.radians(lat2 - lat1) / 2)
    half_lon = F.sin(F.radians(lon2 - lon1) / 2)
    a = half_lat * half_lat + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half_lon * half_lon
    return arc_km(a)


def arc_km(a: Column) -> Column:
    """Distance from a haversine value, guarded against rounding above one."""
    return F.lit(2 * EARTH_RADIUS_KM) * F.asin(F.sqrt(F.least(F.lit(1.0), a)))


def planar_distance(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    return F.sqrt((lat1 - lat2) * (lat1 - lat2) + (lon1 - lon2) * (lon1 - lon2))


def inverse_density(distance: Column) -> Column:
    return F.lit(1.0) / (distance + F.lit(0.1))
