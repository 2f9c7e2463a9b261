"""Importing this package registers every query module."""

from . import analytics, entity, io, ml, privacy, risk, tabular  # noqa: F401
from .base import QUERIES, Query, register, table

__all__ = ["QUERIES", "Query", "register", "table"]
