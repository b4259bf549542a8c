"""Readers for the input tables (parquet with pruned columns).

Every reader selects only the columns an operator needs, so the scan's
``ReadSchema`` stays narrow and filters written after it are pushed into the
parquet reader by Catalyst.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def path(sf_dir: str, name: str) -> str:
    return os.path.join(sf_dir, f"{name}.parquet")


def read(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """Read one driver table; ``columns`` prunes the scan (all when empty)."""
    df = spark.read.parquet(path(sf_dir, name))
    return df.select(*columns) if columns else df


def register_views(spark: SparkSession, sf_dir: str, names=TABLES) -> None:
    """Expose the tables as temporary views for ``spark.sql`` users."""
    for n in names:
        if os.path.exists(path(sf_dir, n)):
            spark.read.parquet(path(sf_dir, n)).createOrReplaceTempView(n)
