"""All registered queries of the engine."""

from . import dimension_queries, event_queries, io_queries, name_queries, quality_queries, report_queries  # noqa: F401
from .registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
