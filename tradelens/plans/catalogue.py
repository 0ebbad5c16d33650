"""Every registered query of the library."""

from . import company_queries, entity_queries, limit_queries, prose_queries, provider_queries, review_queries, site_queries, store_queries, verb_queries, walk_queries
from .registry import ORACLE_SQL, QUERIES

FLAGSHIP = entity_queries.resolve_domains.__name__

__all__ = ["FLAGSHIP", "ORACLE_SQL", "QUERIES", "company_queries", "entity_queries", "limit_queries", "prose_queries", "provider_queries", "review_queries", "site_queries", "store_queries", "verb_queries", "walk_queries"]
