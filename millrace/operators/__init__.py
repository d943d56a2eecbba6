"""Scan, filter, project, aggregate, join, limit, collect."""

from millrace.operators.relational import aggregate, collect, distinct_keys, filter_rows, hash_join, limit, project
from millrace.operators.scan import Pushdown, scan

__all__ = ["Pushdown", "aggregate", "collect", "distinct_keys", "filter_rows", "hash_join", "limit", "project", "scan"]
