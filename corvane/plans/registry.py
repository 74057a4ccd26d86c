"""All queries of the core and their SQL."""

from __future__ import annotations

from corvane.plans import analytics_queries, graph_queries, problem_queries, retrieval_queries, source_queries, text_queries

MODULES = [problem_queries, retrieval_queries, graph_queries, analytics_queries, text_queries, source_queries]


def queries() -> dict:
    return {k: q for m in MODULES for k, q in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {k: q for m in MODULES for k, q in m.SQL.items()}
