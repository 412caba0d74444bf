"""Queries over the test tables, by item of the blueprint, and the SQL that each must agree with."""

from __future__ import annotations

from gondola.plans import compare_queries, history_queries, match_queries, source_queries

QUERIES = {}
ORACLES = {}
for _module in (source_queries, match_queries, compare_queries, history_queries):
    for _name, (_query, _sql) in _module.ALL.items():
        QUERIES[_name] = _query
        if _sql:
            ORACLES[_name] = _sql
