"""Scans of the parquet tables. Every reader projects only what its caller names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def good_reading(valid: str = "qc_valid", value: str = "value", when: str = "timestamp_utc") -> Column:
    """QC passed, value and instant known. NaN counts as unknown."""
    return F.col(valid) & F.col(value).isNotNull() & ~F.isnan(value) & F.col(when).isNotNull()
