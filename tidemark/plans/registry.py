"""All registered queries and their SQL."""

from . import queries_market, queries_rollup, queries_text  # noqa: F401
from .base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
