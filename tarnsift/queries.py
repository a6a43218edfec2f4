"""All queries of the library, by key, with the equivalent DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

for _module in ("retrieval", "relational", "analytics", "text", "chunking", "state", "records", "answers", "pages", "lookups", "store", "cleaning", "search", "reading", "accounts", "sinks", "rules"):
    _plans = import_module(f"tarnsift.plans.{_module}")
    QUERIES |= _plans.QUERIES
    ORACLE_SQL |= _plans.ORACLE_SQL
