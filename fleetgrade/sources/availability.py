"""S3: source availability.

Per workspace, availability is decided from the data (see ``operators.deep``).
A source table that is not there at all (not granted, not enabled) makes the
source unavailable for every workspace: the table is simply left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def optional_table(spark: SparkSession, name: str) -> DataFrame | None:
    """``spark.table(name)`` when the catalog has it, else ``None``."""
    return spark.table(name) if spark.catalog.tableExists(name) else None


def operational_tables(spark: SparkSession, names: dict[str, str]) -> dict[str, DataFrame]:
    """Map of source key -> table for the tables that exist (e.g. ``{"audit": "system.access.audit"}``)."""
    out = {}
    for key, table in names.items():
        df = optional_table(spark, table)
        if df is not None:
            out[key] = df
    return out
