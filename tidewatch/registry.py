"""All registered queries of the engine, with DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from .plans import catalogue, time_and_paths  # noqa: F401 - registers its queries

QUERIES = catalogue.QUERIES
ORACLE_SQL = catalogue.ORACLE_SQL
