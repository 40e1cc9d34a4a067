"""All core queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cairn.plans import classify, features, formats, guidance, journeys, places, privacy, problems, roads, routing, sequences, spatial, tiles, traffic

MODULES = [problems, classify, spatial, traffic, privacy, places, guidance, routing, roads, tiles, sequences, features, journeys, formats]


def flagship(spark: SparkSession, folder: str) -> DataFrame:
    return traffic.t6_estimate(spark, folder)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def sql() -> dict[str, str]:
    return {name: s for m in MODULES for name, s in m.SQL.items()}
