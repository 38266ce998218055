"""Registered queries with their SQL equivalents, grouped by topic."""

from lagloom.queries import preparation, runs, scoring, seasonal  # noqa: F401
from lagloom.queries.registry import ORACLE, QUERIES  # noqa: F401
