"""The queries by name, and the DuckDB SQL that checks them.

Link measurements are read from `events` (a user is a receiver, time is the frame order, value the measurement),
objects from `part` and `lineitem`, points from the first components of `embeddings`."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from fieldloom.plans import documents, geometry, joins, links, scenes, statistics

Query = Callable[[SparkSession, str], DataFrame]
PARTS = (links, joins, statistics, geometry, documents, scenes)

QUERIES: dict[str, Query] = {name: query for part in PARTS for name, query in part.QUERIES.items()}
ORACLE_SQL: dict[str, str] = {name: sql for part in PARTS for name, sql in part.SQL.items()}
