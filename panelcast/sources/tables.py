"""Parquet tables of a data folder (``{dir}/{name}.parquet``)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read_table(spark: SparkSession, data_dir: str, name: str, *cols: str) -> DataFrame:
    """Read one table; selecting ``cols`` here lets the scan read only those columns."""
    df = spark.read.parquet(f"{data_dir.rstrip('/')}/{name}.parquet")
    return df.select(*cols) if cols else df
