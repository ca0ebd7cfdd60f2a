"""All queries of the core library by name."""

from cinderlode.plans import curation_queries, general_queries, intake_queries, maintenance_queries, search_queries

_MODULES = (general_queries, search_queries, curation_queries, maintenance_queries, intake_queries)
QUERIES = {k: v for m in _MODULES for k, v in m.QUERIES.items()}
ORACLE = {k: v for m in _MODULES for k, v in m.ORACLE.items()}
FLAGSHIP = search_queries.bm25_and_topk
