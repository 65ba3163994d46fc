"""Queries over the test tables, each with an SQL statement of the same result."""

from tabkit.plans import calendar_series, learn, prepare, summaries, tables  # noqa: F401,I001
from tabkit.plans.registry import ORACLES, QUERIES  # noqa: F401
