"""Every operator as a named query over the driver tables."""

from prizelens.queries import (  # noqa: F401
    aggregations,
    forecasts,
    joins,
    page_jobs,
    projections,
    rules,
    sources,
    windows,
)
from prizelens.queries.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
