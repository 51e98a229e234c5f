"""All registered queries."""

from logweave.plans import live_queries, load_queries, parse_queries, view_queries  # noqa: F401  (they register themselves)
from logweave.plans.queries import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
