"""Every operator as a query over the driver tables, with its SQL oracle where SQL can express it."""

from cellcast.catalog.registry import oracle_sql, queries

__all__ = ["oracle_sql", "queries"]
