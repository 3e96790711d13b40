"""All queries of the log engine, and their SQL."""

from __future__ import annotations

from logloom.plans import java_queries, log_queries


def queries() -> dict:
    return log_queries.Q | java_queries.Q


def oracle_sql() -> dict[str, str]:
    return log_queries.SQL | java_queries.SQL
