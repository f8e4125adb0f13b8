"""All registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from stratacloud.plans import clouds, detections, motion, neighbourhoods, records, selection, statistics

MODULES = (records, selection, clouds, neighbourhoods, motion, detections, statistics)


def queries() -> dict:
    return {name: query for module in MODULES for name, query in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: text for module in MODULES for name, text in module.ORACLES.items()}


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    return clouds.voted(spark, sf, min_views=2)
