"""Shared scratch folders and tables under ``spark.checkpoint.dir``."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tabflow.session import checkpoint_dir


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A fresh path (not yet made) below the checkpoint folder that all executors share.  What stands
    there goes when the application ends."""
    path = f"{checkpoint_dir(spark).rstrip('/')}/{purpose}-{uuid.uuid4().hex}"
    place, fs = _file_system(spark, path)
    fs.deleteOnExit(place)
    return path


def written(df: DataFrame, purpose: str) -> DataFrame:
    """The rows written once as a Parquet table in the shared folder and read back: later steps
    start from files that outlive any executor."""
    spark = df.sparkSession
    path = shared_folder(spark, purpose)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Remove tables that ``written`` made, once everything that reads them has been written itself."""
    for table in tables:
        place, fs = _file_system(table.sparkSession, table._scratch_path)
        fs.delete(place, True)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have, whatever its letters' case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def _file_system(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark._jsc.hadoopConfiguration())
