"""Every registered query with its DuckDB counterpart."""

from gossamer.plans.queries import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
