"""Profiling operators: each takes a DataFrame and returns a small report DataFrame."""

from . import codes, columns, coverage, dates, keys, reconcile, report, rules, volume

__all__ = ["codes", "columns", "coverage", "dates", "keys", "reconcile", "report", "rules", "volume"]
