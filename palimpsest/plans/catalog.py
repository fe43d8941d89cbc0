"""All registered queries and their SQL."""

from __future__ import annotations

from . import chapters, refinery  # noqa: F401
from .queries import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
