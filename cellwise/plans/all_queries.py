"""Imports every query module so that the registry is complete."""

from cellwise.plans import fidelity_queries, record_queries, report_queries, sampling_queries  # noqa: F401
from cellwise.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
