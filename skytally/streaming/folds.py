"""Monthly sums and a level filter over streams of readings."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skytally.functions.columns import month_ordinal
from skytally.session import prepare
from skytally.sources.tables import good_reading


def reading_stream(spark: SparkSession, sf_dir: str, files_per_trigger: int = 4) -> DataFrame:
    """obs_parsed as a stream of its files, be it a folder of parts or one file."""
    path = f"{sf_dir}/obs_parsed.parquet"
    reader = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", files_per_trigger)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at).isDirectory():
        return reader.parquet(path)
    return reader.option("pathGlobFilter", "obs_parsed.parquet").parquet(sf_dir)


def monthly_counts(stream: DataFrame) -> DataFrame:
    """Running counts and sums per record and month; state is one row per cell, however late a delivery comes."""
    return stream.where(good_reading()).groupBy("record_id", month_ordinal(F.col("timestamp_utc")).cast("long").alias("mo")).agg(
        F.count(F.lit(1)).alias("n"), F.min("value").alias("lowest"), F.max("value").alias("highest"))


def run_to_table(stream: DataFrame) -> DataFrame:
    """Run a complete-mode stream over all that is there and read what it last wrote."""
    spark = prepare(stream.sparkSession)
    base = f"{spark.sparkContext.getCheckpointDir()}/stream-{uuid.uuid4().hex}"

    def write(df: DataFrame, _: int) -> None:
        df.write.mode("overwrite").parquet(f"{base}/table")

    q = (stream.writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", f"{base}/state")
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/table")


def level_filter(stream: DataFrame, q: float, r: float) -> DataFrame:
    """Forward local-level filter per record over a stream; state is level, variance and the last instant.

    Readings of one trigger are taken in order of time; a reading older than the last one
    seen doesn't move the level and comes out with late true.
    """
    rows = stream.where(good_reading()).select("record_id", F.unix_micros("timestamp_utc").alias("us"), "value")
    out = "record_id string, us long, value double, level double, late boolean"

    def run(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        level, var, last = state.get if state.exists else (None, 0.0, -(2**62))
        pdf = pd.concat(list(batches)).sort_values(["us", "value"])
        rows = []
        for us, x in zip(pdf["us"], pdf["value"]):
            late = us < last
            if not late:
                if level is None:
                    level, var = x, 100 * r
                var += q
                gain = var / (var + r)
                level, var, last = level + gain * (x - level), var * (1 - gain), int(us)
            rows.append((key[0], int(us), float(x), float(level), late))
        state.update((float(level), float(var), int(last)))
        yield pd.DataFrame(rows, columns=["record_id", "us", "value", "level", "late"])

    return rows.groupBy("record_id").applyInPandasWithState(run, out, "level double, var double, last long", "append", "NoTimeout")
