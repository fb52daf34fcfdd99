"""Readers for the table folder: one parquet file or folder per table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """Scan ``{folder}/{name}.parquet``; column pruning and filters reach the parquet reader."""
    return spark.read.parquet(f"{folder}/{name}.parquet")
