"""Registered queries: name -> Spark query, and the SQL that must give the same rows."""

from flowloom.catalog import federation, graphs, preparation, scoring  # noqa: F401
from flowloom.catalog.common import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
