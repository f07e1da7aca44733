"""The registered queries and their DuckDB twins."""

from __future__ import annotations

from factorlake.plans import context_queries, factor_queries, stream_queries, technical_queries
from factorlake.plans.factor_queries import flagship

_MODULES = (factor_queries, technical_queries, context_queries, stream_queries)
__all__ = ["flagship", "oracle_sql", "queries"]


def queries() -> dict:
    return {k: f for m in _MODULES for k, f in m.queries().items()}


def oracle_sql() -> dict[str, str]:
    return {k: q for m in _MODULES for k, q in m.oracle_sql().items()}
