"""Readers. ``tables(spark, dir)`` gives the Parquet tables of a directory by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{name}.parquet")


def state_of(spark: SparkSession, root: str, *names: str) -> tuple:
    """Sizes and times of tables' files: what tells one state of the tables from another."""
    found = []
    for name in names:
        at = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{name}.parquet")
        fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
        status = fs.getFileStatus(at)
        found.append((name, fs.getContentSummary(at).getLength(), status.getModificationTime()))
    return tuple(found)
