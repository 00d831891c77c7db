"""The registered queries of the graph engine and their DuckDB SQL."""

from __future__ import annotations

from .plans import graph_queries, session_queries, text_queries, vector_queries

MODULES = (graph_queries, vector_queries, text_queries, session_queries)


def queries() -> dict:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {name: sql for m in MODULES for name, sql in m.SQL.items()}
