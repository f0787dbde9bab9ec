"""Operators of a training-data pipeline; nothing else in the package imports them."""

from millrace.llm import manifest_query, ngram_query, queries, repair_query  # noqa: F401
from millrace.llm.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
