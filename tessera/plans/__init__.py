"""All queries of the engine but those on training text."""

from . import evaluators, files, metrics, pairs, scalars, tables  # noqa: F401
from .registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
