"""Registered queries and the plain SQL that must agree with them."""

from cellfleet.catalog import contract_queries, learning_queries, prognostic_queries, report_queries, replay_queries, series_queries  # noqa: F401
from cellfleet.catalog.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
