"""The queries of the engine; importing this registers them."""

from . import access, functions, more, routing, tables
from .registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES", "access", "functions", "more", "routing", "tables"]
