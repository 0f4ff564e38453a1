"""Queries over the driver's tables and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .plans import boxes_and_checks, events_and_stints, people_and_tables, ratings_and_panels, window_panels

GROUPS = (events_and_stints, boxes_and_checks, people_and_tables, ratings_and_panels, window_panels)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: query for group in GROUPS for name, query in group.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for group in GROUPS for name, sql in group.SQL.items()}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ridge ratings of every player from the stints."""
    return queries()["ridge_ratings"](spark, sf_dir)
