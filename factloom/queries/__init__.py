"""Registered queries over the driver's tables, one or more for each operator family."""

from factloom.queries import checks, governance, knowledge, lifecycle, query_model
from factloom.queries.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "checks", "governance", "knowledge", "lifecycle", "query_model"]
