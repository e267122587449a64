"""All registered queries of the engine's own operators, with the SQL that checks them."""

from laurel.plans import alias_queries, domain, incremental, lookups, relational  # noqa: F401
from laurel.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
