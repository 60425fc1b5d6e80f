"""Queries of the library by name, and the equivalent SQL."""

from __future__ import annotations

from .plans import corpus_queries, curve_queries, file_queries, model_queries, text_queries

_ALL = (text_queries, corpus_queries, curve_queries, model_queries, file_queries)
QUERIES: dict = {k: v for m in _ALL for k, v in m.QUERIES.items()}
SQL: dict = {k: v for m in _ALL for k, v in m.SQL.items()}
