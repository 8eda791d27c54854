"""Scans of the Parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One Parquet table of a folder, a lazy scan that Catalyst prunes."""
    return spark.read.parquet(f"{folder}/{name}.parquet")
