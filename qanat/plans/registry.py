"""All queries over the reference's own operators and their DuckDB oracles."""

from qanat.plans import answer_queries, evaluation_queries, retrieval_queries, streaming_queries, table_queries, telemetry_queries, text_queries  # noqa: F401
from qanat.plans.base import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
