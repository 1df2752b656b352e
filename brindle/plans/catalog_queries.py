"""All registered queries of the engine's own operators."""

from . import bucket_queries, decision_queries, detail_queries, evaluation_queries, evidence_queries, fact_queries, parser_queries, policy_queries, ranker_queries, ranking_queries, search_queries, session_queries, span_queries  # noqa: F401
from .registry import ORACLE, QUERIES  # noqa: F401
