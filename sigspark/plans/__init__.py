"""The registered queries: importing this package fills QUERIES and SQL."""

from . import benchmarks, longs, preparation, reports, stored, streams, tables, vectors  # noqa: F401
from .registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
