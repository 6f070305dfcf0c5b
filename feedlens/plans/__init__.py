"""Registered queries and their SQL twins.

Importing this package loads every query module, filling ``QUERIES`` and
``ORACLE``.
"""

from feedlens.plans.oracle import ORACLE
from feedlens.plans.queries import QUERIES
from feedlens.plans import tagging_queries  # noqa: F401  (registers queries)
from feedlens.plans import validation_queries  # noqa: F401  (registers queries)

__all__ = ["ORACLE", "QUERIES"]
