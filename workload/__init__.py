"""Registered queries: every operator over the supplied tables, with its SQL."""

from . import coverage, discovery, history, keys, plans, profile, rules, sources  # noqa: F401
from .base import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
