"""All registered queries."""
from __future__ import annotations

from . import candidate_queries, feed_queries, judging_queries, report_queries, requirement_queries, scoring_queries, shortlist_queries, text_queries

MODULES = (text_queries, candidate_queries, shortlist_queries, requirement_queries, judging_queries, report_queries, scoring_queries, feed_queries)
QUERIES = {name: f for m in MODULES for name, f in m.QUERIES.items()}
ORACLES = {name: sql for m in MODULES for name, sql in m.ORACLES.items()}
