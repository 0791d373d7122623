"""Registry of the library's queries and their DuckDB counterparts."""

from __future__ import annotations

from . import queries_models, queries_series, queries_summary
from .queries_series import flagship

QUERIES: dict = {**queries_series.QUERIES, **queries_summary.QUERIES, **queries_models.QUERIES}
ORACLES: dict = {**queries_series.ORACLES, **queries_summary.ORACLES, **queries_models.ORACLES}

__all__ = ["ORACLES", "QUERIES", "flagship"]
