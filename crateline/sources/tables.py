"""Readers of the catalogue tables (one Parquet file or folder per table)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def load(spark: SparkSession, folder: str, table: str) -> DataFrame:
    """The table ``table`` of a catalogue folder."""
    return spark.read.parquet(f"{folder}/{table}.parquet")
