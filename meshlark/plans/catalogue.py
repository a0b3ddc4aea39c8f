"""All core queries with their SQL counterparts, by topic."""

from __future__ import annotations

from meshlark.plans import field_queries, grid_queries, mesh_queries, model_queries, sample_queries, table_queries

TOPICS = (grid_queries, table_queries, mesh_queries, field_queries, sample_queries, model_queries)


def queries() -> dict:
    return {name: q for topic in TOPICS for name, q in topic.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for topic in TOPICS for name, sql in topic.ORACLES.items()}
