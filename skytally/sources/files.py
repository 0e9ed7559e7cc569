"""Delimited and configuration files."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession


def read_csv(spark: SparkSession, path: str, schema: str, missing: str = "NA") -> DataFrame:
    """CSV with a header and a stated schema; ``missing`` and blanks are null, a byte-order mark is skipped; a header or a row that doesn't fit raises."""
    return spark.read.schema(schema).option("header", True).option("nullValue", missing).option("mode", "FAILFAST").option("enforceSchema", False).csv(path)


def read_config(spark: SparkSession, path: str) -> dict:
    """One JSON configuration, which is a setting and not data."""
    return json.loads("\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect()))
