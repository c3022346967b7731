"""Every registered query with its oracle SQL."""

from __future__ import annotations

from tessera.plans import base, interval_queries, language_queries, lineage_queries, metric_queries, record_queries, retrieval_queries, review_queries  # noqa: F401  (importing registers the queries)


def queries() -> dict:
    return dict(base.QUERIES)


def oracle_sql() -> dict:
    return dict(base.SQL)


def flagship(spark, sf_dir):
    """Hybrid retrieval: BM25 and cosine fused by reciprocal ranks."""
    return retrieval_queries.rrf_hybrid_topk(spark, sf_dir)
