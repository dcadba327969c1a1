"""Raw parquet tables of a scale-factor directory."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

RAW_TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


def raw_path(sf_dir: str, name: str) -> str:
    return os.path.join(sf_dir, f"{name}.parquet")


def load_raw(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(raw_path(sf_dir, name))


def register_raw(spark: SparkSession, sf_dir: str, names) -> None:
    """Expose raw tables as temp views named like the files (as the SQL oracle sees them)."""
    for name in names:
        load_raw(spark, sf_dir, name).createOrReplaceTempView(name)
