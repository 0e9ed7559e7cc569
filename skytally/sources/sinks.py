"""Writers of results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_parquet(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    w = df.write.mode("overwrite")
    (w.partitionBy(*partition_by) if partition_by else w).parquet(path)


def write_csv(df: DataFrame, path: str, missing: str = "NA") -> None:
    """CSV with a header, doubles in their shortest exact form and a marker for nulls."""
    df.write.mode("overwrite").option("header", True).option("nullValue", missing).csv(path)


def summary_json(df: DataFrame) -> DataFrame:
    """Rows as JSON text with every field, null ones too."""
    return df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("json"))
