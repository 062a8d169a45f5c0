"""Registered queries over the test tables, grouped by theme."""

from tidewatch.plans.registry import ORACLES, QUERIES
from tidewatch.plans import q_eval, q_joins, q_models, q_scalars, q_sources, q_streaming, q_windows  # noqa: F401

__all__ = ["ORACLES", "QUERIES"]
