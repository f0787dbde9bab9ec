"""The queries by which the package is checked and timed."""

from millrace.catalogue import changes, decoding, drift, loop, state, streams, summaries, tables, text, times, windows  # noqa: F401
from millrace.catalogue.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
