"""Runnable queries over the benchmark tables, each with its oracle text where SQL can say it."""

from perfloom.plans import profile_queries, reader_queries, rule_queries, stream_queries, trace_queries  # noqa: F401
from perfloom.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
