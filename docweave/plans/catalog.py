"""All queries of the core, with their SQL."""

from docweave.plans import block_queries, cluster_queries, integrity, text_queries, tree_queries

_PARTS = (integrity, block_queries, tree_queries, text_queries, cluster_queries)
QUERIES = {name: query for part in _PARTS for name, query in part.QUERIES.items()}
ORACLE = {name: sql for part in _PARTS for name, sql in part.ORACLE.items()}
