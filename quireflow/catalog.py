"""All queries of the core."""

from __future__ import annotations

from quireflow.operators import decision_queries, evaluation_queries, graph_queries, ingest_queries, reference_queries, retrieval_queries

QUERIES: dict = {}
SQL: dict = {}
for _module in (reference_queries, retrieval_queries, graph_queries, ingest_queries, decision_queries, evaluation_queries):
    QUERIES |= _module.QUERIES
    SQL |= _module.SQL
