"""Registered queries: every operator run on the given tables, each with SQL for the same result."""

from cohortloom.queries import analyses, cells, counts, matching, matrices, models, ranks, tables  # noqa: F401
from cohortloom.queries.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
