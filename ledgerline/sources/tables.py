"""Readers for the driver's parquet tables."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations"]

# One DataFrame per (application, path): the file listing and footer read
# happen once per session, not once per query. Plans only; no data is cached.
_READ_CACHE: dict[tuple[str, str], DataFrame] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One driver table. Callers select the columns they need right away, so
    the scan's ReadSchema holds only those (column pruning)."""
    path = os.path.join(sf_dir, f"{name}.parquet")
    key = (spark.sparkContext.applicationId, path)
    df = _READ_CACHE.get(key)
    if df is None or df.sparkSession is not spark:
        df = spark.read.parquet(path)
        _READ_CACHE[key] = df
    return df
