"""Parquet tables (the driver's fixtures)."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

from tabflow.functions.columns import normalize_missing

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def parquet_source(spark: SparkSession, path: str, normalize: bool = False) -> DataFrame:
    """Parquet as is.  Operators read NaN as missing themselves, so filters on floating
    columns still reach the scan; ``normalize=True`` rewrites NaN to NULL up front."""
    df = spark.read.parquet(path)
    return normalize_missing(df) if normalize else df


def load_table(spark: SparkSession, sf_dir: str, name: str, normalize: bool = False) -> DataFrame:
    """``{sf_dir}/{name}.parquet`` as a DataFrame; column pruning and filters reach the scan."""
    return parquet_source(spark, os.path.join(sf_dir, f"{name}.parquet"), normalize)
