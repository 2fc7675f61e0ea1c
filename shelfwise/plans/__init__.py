"""All registered queries."""

from shelfwise.plans import core_queries, ingest_queries, model_queries, ops_queries, shelf_queries  # noqa: F401
from shelfwise.plans.registry import QUERIES, TWINS

__all__ = ["QUERIES", "TWINS"]
