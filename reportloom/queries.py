"""All queries of the engine and their SQL."""

from __future__ import annotations

from reportloom.plans import q_appended, q_basics, q_compare, q_files, q_fill, q_reports, q_scalars, q_terms  # noqa: F401
from reportloom.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
