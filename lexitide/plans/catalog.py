"""Every registered query of the caption and vocabulary operators, with DuckDB SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lexitide.plans import caption_queries, io_queries, row_queries, segmentation_queries, space_queries

_PARTS = (segmentation_queries, caption_queries, io_queries, row_queries, space_queries)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {name: query for part in _PARTS for name, query in part.QUERIES.items()}
ORACLE_SQL: dict[str, str] = {name: sql for part in _PARTS for name, sql in part.ORACLE_SQL.items()}
