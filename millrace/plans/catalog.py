"""Registry of the engine's own queries and their DuckDB equivalents."""

from __future__ import annotations

from collections.abc import Callable

from millrace.plans import ingest_queries, lake_queries, record_queries, search_queries, state_queries, workspace_queries

_MODULES = (search_queries, lake_queries, state_queries, record_queries, ingest_queries, workspace_queries)


def queries() -> dict[str, Callable]:
    return {n: f for m in _MODULES for n, (f, _) in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {n: sql for m in _MODULES for n, (_, sql) in m.QUERIES.items() if sql}
