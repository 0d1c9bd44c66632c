"""All queries of the library, without the training-data ones."""

from __future__ import annotations

from . import calibration_queries, claim_queries, entropy_queries, governance_queries, note_queries, review_queries, table_queries  # noqa: F401  they register themselves
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
