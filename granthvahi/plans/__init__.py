"""Queries over the tables, by name."""

from . import documents, editorial, tables  # noqa: F401
from .registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
