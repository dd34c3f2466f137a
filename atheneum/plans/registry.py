"""All registered queries."""

from . import job_queries, stored_queries, text_queries  # noqa: F401  they register theirs
from .catalog import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
