"""Imports every module that registers queries, and gives the whole registry."""

from loamdex.plans import cohorts, context, evaluation, graph, ledger, memory, more, replay, rules, runs, search, serving, star, stored, stores, text  # noqa: F401
from loamdex.plans.registry import FLAGSHIP, ORACLES, QUERIES

__all__ = ["FLAGSHIP", "ORACLES", "QUERIES"]
