"""All queries of the library with their SQL oracles, gathered from the plan modules."""

from __future__ import annotations

from . import assessment_plans, catalog_plans, focal_plans, fusion_plans, index_plans, kernel_plans, more_plans, raster_plans, resilience_plans, source_plans, state_plans, statistics_plans, streaming_plans, taxonomy_plans, temporal_plans  # noqa: F401
from .registry import QUERIES, SQL, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
