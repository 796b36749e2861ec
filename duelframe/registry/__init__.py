"""Queries over the given tables, one per operator, with the SQL they must agree with."""

from __future__ import annotations

from duelframe.registry.base import QUERIES, SQL, load_all

__all__ = ["QUERIES", "SQL", "load_all"]
