"""All queries of the library by name, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import attribution, graph, relational, rules, scoring, spatial

PARTS = (scoring, spatial, attribution, relational, graph, rules)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which segments are on the priority lists."""
    return scoring.q11(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for part in PARTS for name, f in part.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: text for part in PARTS for name, text in part.SQL.items()}
