"""All registered disclosure queries, and their SQL."""

from __future__ import annotations

from ledgerline.plans import domain_queries, feed_queries, record_queries

QUERIES = feed_queries.QUERIES | domain_queries.QUERIES | record_queries.QUERIES
SQL = feed_queries.SQL | domain_queries.SQL | record_queries.SQL
SQL["us_query"] = SQL["us_query"].replace("__LINKS__", domain_queries.links("copies")).replace("__COPIES__", domain_queries.COPIES)
