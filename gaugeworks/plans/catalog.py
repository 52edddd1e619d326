"""All registered telemetry queries: over facts, and over logs and spans as they land."""

from gaugeworks.plans import chart_queries, health_queries, queries, snapshot_queries, source_queries  # noqa: F401
from gaugeworks.plans.registry import ORACLES, QUERIES  # noqa: F401
