"""All queries and SQL of this subpackage, for the driver's entry module."""

from __future__ import annotations

from reelspark.llm import queries_cluster, queries_ranked, queries_text

_MODULES = [queries_ranked, queries_cluster, queries_text]

QUERIES = {name: query for module in _MODULES for name, query in module.QUERIES.items()}
ORACLES = {name: sql for module in _MODULES for name, sql in module.ORACLES.items()}
