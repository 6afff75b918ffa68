"""Registered queries (one per operator key) and their DuckDB oracle SQL."""

from turnlens.plans.registry import QUERIES, ORACLES  # noqa: F401
from turnlens.plans import q_ser, q_basic, q_linearize, q_metrics, q_analysis, q_tokens, q_files, q_udf, q_phrases, q_stream  # noqa: F401
