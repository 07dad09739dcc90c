"""All query modules, imported for their registration."""

from nearfield.plans import analytics_queries, scheme_queries, vector_queries  # noqa: F401
from nearfield.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
