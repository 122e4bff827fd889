"""One query per operator over the given tables, each with equivalent SQL."""

from catalog_queries import index, jobs, landing, relations, scalars  # noqa: F401
from catalog_queries.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
