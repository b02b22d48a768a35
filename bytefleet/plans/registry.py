"""All queries of the library proper by name, with their SQL."""

from __future__ import annotations

from bytefleet.plans import container_queries, format_queries, relation_queries, search_queries

FLAGSHIP = "inside_ci"
_MODULES = (search_queries, relation_queries, container_queries, format_queries)
QUERIES = {name: query for module in _MODULES for name, query in module.QUERIES.items()}
ORACLE_SQL = {name: sql for module in _MODULES for name, sql in module.ORACLE_SQL.items()}
