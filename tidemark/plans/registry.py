"""All queries of the engine by name, and their SQL."""

from tidemark.plans import listing_queries, operations_queries, record_queries, text_queries

MODULES = [listing_queries, operations_queries, text_queries, record_queries]
QUERIES = {k: v for m in MODULES for k, v in m.QUERIES.items()}
ORACLES = {k: v for m in MODULES for k, v in m.ORACLES.items()}
