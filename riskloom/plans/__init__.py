"""Registered queries and their SQL equivalents."""

from riskloom.plans import embeddings, loading, metrics, panel, ranking, streams, texts  # noqa: F401
from riskloom.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
