"""The queries over the driver's tables, each with the SQL that DuckDB answers it with."""

from .registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
