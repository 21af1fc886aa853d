"""One named query per operator over the driver's tables, each with the SQL that must give the same rows."""

from lifethread.plans.catalog.registry import oracles, queries

__all__ = ["oracles", "queries"]
