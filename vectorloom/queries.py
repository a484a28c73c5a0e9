"""The library's queries by name, with the equivalent DuckDB SQL."""

from __future__ import annotations

from vectorloom.plans import log_queries, structure_queries, text_queries, vector_queries
from vectorloom.plans.registry import ORACLE, QUERIES

flagship = vector_queries.flagship

__all__ = ["ORACLE", "QUERIES", "flagship", "log_queries", "structure_queries", "text_queries"]
