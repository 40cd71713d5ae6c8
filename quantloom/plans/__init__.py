"""All registered queries."""

from quantloom.plans import analysis, feeds, market, more, reviews, scans, streams, trading  # noqa: F401
from quantloom.plans.registry import ORACLE
from quantloom.plans.registry import QUERIES as ALL

__all__ = ["ALL", "ORACLE"]
