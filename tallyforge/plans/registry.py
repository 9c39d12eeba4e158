"""All queries of the library, and their SQL."""

from __future__ import annotations

from . import kernel_queries, model_queries, row_queries, sequence_queries, stats_queries, store_queries

MODULES = (row_queries, sequence_queries, stats_queries, model_queries, kernel_queries, store_queries)
QUERIES = {name: f for m in MODULES for name, f in m.QUERIES.items()}
SQL = {name: text for m in MODULES for name, text in m.SQL.items()}
