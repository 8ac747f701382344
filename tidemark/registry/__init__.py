"""All registered queries."""

from tidemark.registry import chains, fits, reports, rows, windows  # noqa: F401
from tidemark.registry.core import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
