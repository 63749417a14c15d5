"""All registered queries."""

from catalog import filters, results, steps, stored  # noqa: F401
from catalog.registry import ORACLES, QUERIES
from catalog.steps import FLAGSHIP

__all__ = ["FLAGSHIP", "ORACLES", "QUERIES"]
