"""Registered queries (Spark) and their DuckDB oracle SQL."""

from markscope.plans.queries import QUERIES  # noqa: F401
from markscope.plans.oracle import ORACLE_SQL  # noqa: F401
