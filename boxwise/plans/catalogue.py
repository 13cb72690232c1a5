"""All queries by name, and their SQL twins."""

from __future__ import annotations

from boxwise.plans import audit_queries, box_queries, check_queries, corpus_queries, heading_queries, layout_queries, merge_queries, record_queries, validation_queries
from boxwise.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES", "audit_queries", "box_queries", "check_queries", "corpus_queries", "heading_queries", "layout_queries", "merge_queries", "record_queries", "validation_queries"]
