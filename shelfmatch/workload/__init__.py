"""Queries over the driver's tables, one per operator, with their SQL."""

from shelfmatch.workload import views  # noqa: F401  (registers the views first)
from shelfmatch.workload import catalog, feedback, files, fusion, quality, retrieval, text  # noqa: F401
from shelfmatch.workload.base import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
