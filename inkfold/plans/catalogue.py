"""Imports every module that registers queries."""

from inkfold.plans import geometry_queries, line_queries, policy_queries, stream_queries, text_queries, verify_queries  # noqa: F401
from inkfold.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
