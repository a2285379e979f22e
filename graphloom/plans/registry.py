"""All registered queries of the library."""

from graphloom.plans import more  # noqa: F401
from graphloom.plans.catalogue import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
