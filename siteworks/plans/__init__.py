"""Registered plans by family; importing this package registers all of them."""

from siteworks.plans import (  # noqa: F401
    aggregates,
    cleaning,
    derived,
    encoding,
    enrichment,
    evaluation,
    joining,
    modelling,
    scans,
    sorting,
    spatial,
)
from siteworks.plans.registry import CHECKS, PLANS  # noqa: F401
