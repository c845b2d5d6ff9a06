"""All registered queries."""

from checks import billing, deid, text  # noqa: F401
from checks.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
