"""All queries of this subpackage and their SQL."""

from tagloom.llm import record_queries, text_queries

_PARTS = [record_queries, text_queries]
QUERIES = {name: f for part in _PARTS for name, f in part.QUERIES.items()}
ORACLE = {name: sql for part in _PARTS for name, sql in part.ORACLE.items()}
