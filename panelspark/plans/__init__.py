"""All registered queries and their oracle SQL."""

from . import composites, events, landing, live, market, series  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
