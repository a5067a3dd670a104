"""Every query of the library by name, with its oracle SQL."""

from __future__ import annotations

from . import book_queries, dealt_queries, edge_queries, table_queries, text_queries  # noqa: F401
from .registry import ORACLES, QUERIES  # noqa: F401
