"""Queries by name over the driver's tables, and their SQL."""

from __future__ import annotations

from . import action_queries, corpus_queries, cost_queries, replay_queries, session_queries, summary_queries, text_queries

QUERIES: dict = {}
SQL: dict = {}
for _part in (session_queries, text_queries, corpus_queries, action_queries, cost_queries, summary_queries, replay_queries):
    QUERIES |= _part.QUERIES
    SQL |= _part.SQL
