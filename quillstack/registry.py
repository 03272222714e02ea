"""Queries over the driver's tables, and the SQL that each must agree with."""

from __future__ import annotations

from .plans import geometry, portable, reading, rendering, sources, stateful  # noqa: F401
from .plans.queries import ORACLE_SQL, QUERIES

FLAGSHIP = "block_offsets"

__all__ = ["FLAGSHIP", "ORACLE_SQL", "QUERIES"]
