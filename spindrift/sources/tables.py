"""Table readers.  Every reader is lazy; Catalyst prunes columns and pushes filters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read one Parquet table of a data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
