"""Register of runnable plans and the SQL each is checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Plan = Callable[[SparkSession, str], DataFrame]

PLANS: dict[str, Plan] = {}
CHECKS: dict[str, str] = {}


def plan(name: str, check: str | None = None) -> Callable[[Plan], Plan]:
    def add(build: Plan) -> Plan:
        if name in PLANS:
            raise ValueError(f"plan {name} registered twice")
        PLANS[name] = build
        if check is not None:
            CHECKS[name] = check
        return build

    return add


def r6(c: Column | str) -> Column:
    """Doubles are compared at six decimals."""
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


def r6_all(df: DataFrame) -> DataFrame:
    return df.select(*[r6(c).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def iso(c: Column | str) -> Column:
    return F.date_format(c, "yyyy-MM-dd")
