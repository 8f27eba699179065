"""All queries of the library proper and their SQL, by name."""

from __future__ import annotations

from cohortflow.plans import event_queries, evidence_queries, rating_queries, recompute_queries, store_queries, text_queries

QUERIES = {**rating_queries.QUERIES, **event_queries.QUERIES, **text_queries.QUERIES, **store_queries.QUERIES, **evidence_queries.QUERIES, **recompute_queries.QUERIES}
ORACLES = {**rating_queries.ORACLES, **event_queries.ORACLES, **text_queries.ORACLES, **store_queries.ORACLES, **evidence_queries.ORACLES, **recompute_queries.ORACLES}
