"""All registered queries."""

from __future__ import annotations

from marklake.plans import dashboard_queries, learning_queries, segment_queries, text_queries, evidence_queries, source_queries, grading_queries

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

for _module in (dashboard_queries, learning_queries, segment_queries, text_queries, evidence_queries, source_queries, grading_queries):
    QUERIES.update(_module.query.queries)
    ORACLES.update(_module.query.oracles)
