"""Worked queries, one per operator, with the SQL they must agree with."""

from . import cases, editions, filters, gates, links, orders, panels, places, privacy, scalars, scans, setops, subjects, totals  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
