"""All named queries."""

from signaldeck.plans import (  # noqa: F401
    archive_queries,
    envelope_queries,
    metric_queries,
    search_queries,
    source_queries,
    state_queries,
    stream_queries,
    trace_queries,
    wire_queries,
)
from signaldeck.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
