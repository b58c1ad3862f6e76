"""Readers for the driver's parquet tables.

Every reader returns a lazy ``DataFrame``; projection and filters applied later
are pushed into the parquet scan by Catalyst (``ReadSchema`` / ``PushedFilters``).
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

DRIVER_TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem",
                 "events", "documents", "embeddings", "pages", "benchmark", "labels",
                 "conversations"]


def table_path(sf_dir: str, name: str) -> str:
    return os.path.join(sf_dir, f"{name}.parquet")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(table_path(sf_dir, name))


def scan_project(spark: SparkSession, sf_dir: str, name: str, columns: list[str]) -> DataFrame:
    """Table scan with a column list (``SELECT a, b FROM t``)."""
    return read_table(spark, sf_dir, name).select(*columns)


def register_driver_views(spark: SparkSession, sf_dir: str) -> None:
    for name in DRIVER_TABLES:
        path = table_path(sf_dir, name)
        if os.path.exists(path):
            spark.read.parquet(path).createOrReplaceTempView(name)
