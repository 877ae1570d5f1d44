"""Queries over the test tables, each with the SQL that gives the same rows."""

from barwright.plans import queries_catalog, queries_quality, queries_series, queries_store, queries_text  # noqa: F401
from barwright.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
