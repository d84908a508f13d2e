"""Named queries over the test tables with their DuckDB oracle SQL."""

from missaware.catalog import q_fit, q_io, q_model, q_prep, q_score, q_stats  # noqa: F401
from missaware.catalog.registry import ORACLES, QUERIES

__all__ = ["QUERIES", "ORACLES"]
