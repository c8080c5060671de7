"""Named queries over the driver's tables and, where SQL can express them, their DuckDB SQL."""

from . import aggregation, claims, evidence, knowledge, reports, texts
from .common import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
