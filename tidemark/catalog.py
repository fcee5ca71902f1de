"""All queries of the engine by operator, with the SQL that gives the same rows."""

from __future__ import annotations

from .plans import delta_queries, evidence_queries, index_queries, learning_queries, mart_queries, scope_queries, search_queries, track_queries  # noqa: F401
from .registry import ORACLES, QUERIES, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
