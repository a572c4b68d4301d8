"""Registered queries of the library."""

from tessella.plans import choice_queries, describe_queries, evaluate_queries, method_queries, solution_queries  # noqa: F401
from tessella.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
