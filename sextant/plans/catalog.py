"""Registered queries and their SQL, by name."""

from sextant.plans import changes, checks, evaluation, exports, ranking  # noqa: F401
from sextant.plans.register import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
