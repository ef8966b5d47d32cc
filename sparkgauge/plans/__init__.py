"""Query plans over the driver's tables, each with the SQL that states the same result."""

from __future__ import annotations

from . import analysis, assembly, calibration, changes, code, estimate, evaluation, infrastructure, portfolios, reporting, series, trees
from .registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES", "analysis", "assembly", "calibration", "changes", "code", "estimate", "evaluation", "infrastructure", "portfolios", "reporting", "series", "trees"]
