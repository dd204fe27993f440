"""All registered queries of the library's own operators, and their SQL."""

from __future__ import annotations

from . import reviews  # noqa: F401  registers its queries
from .catalog import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
