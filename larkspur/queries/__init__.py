"""Every operator of the library applied to whole tables, with SQL that gives the same rows."""

from larkspur.queries import models, prices, series, statistics, tables  # noqa: F401
from larkspur.queries.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
