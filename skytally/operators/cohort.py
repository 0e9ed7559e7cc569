"""Completeness: dense months, qualification, threshold grids and cohort summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skytally.functions.columns import month_days


def dense_months(monthly: DataFrame, key: list[str], first: int, months: int) -> DataFrame:
    """Every key in every month of the target period; absent months count 0 days of their expected ones."""
    grid = monthly.select(*key).distinct().withColumn("mo", F.explode(F.sequence(F.lit(first), F.lit(first + months - 1)).cast("array<long>")))
    d = grid.join(monthly.select(*key, "mo", "n", "days", "mean"), [*key, "mo"], "left")
    d = d.withColumns({"n": F.coalesce("n", F.lit(0)), "days": F.coalesce("days", F.lit(0)), "expected": month_days(F.col("mo")).cast("long")})
    return d.withColumn("coverage", F.col("days") / F.col("expected"))


def qualify(df: DataFrame, threshold: float | Column) -> DataFrame:
    """Months whose coverage reaches the threshold."""
    return df.withColumn("qualified", F.col("coverage") >= threshold)


def grid(spark: SparkSession, within: list[float], station: list[float]) -> DataFrame:
    return spark.createDataFrame([(float(w), float(s)) for w in within for s in station], "within double, station double")


def qualified_fractions(dense: DataFrame, key: list[str], within: list[float]) -> DataFrame:
    """Share of the target's months that qualify, per key and threshold, in one aggregation."""
    aggs = [F.avg((F.col("coverage") >= w).cast("double")).alias(f"q{i}") for i, w in enumerate(within)]
    wide = dense.groupBy(*key).agg(*aggs)
    rows = F.array(*[F.struct(F.lit(float(w)).alias("within"), F.col(f"q{i}").alias("fraction")) for i, w in enumerate(within)])
    return wide.select(*key, F.inline(rows))


def threshold_grid(fractions: DataFrame, station: list[float]) -> DataFrame:
    """Per (within, station threshold): datasets kept, places, places with two gases or more, regions."""
    rows = fractions.withColumn("station", F.explode(F.array(*[F.lit(float(s)) for s in station]))).withColumn("keep", F.col("fraction") >= F.col("station"))
    place = rows.groupBy("within", "station", "place").agg(
        F.sum(F.col("keep").cast("long")).alias("kept"), F.countDistinct(F.when(F.col("keep"), F.col("gas"))).alias("gases"),
        F.max(F.when(F.col("keep"), F.col("region"))).alias("region"))
    return place.groupBy("within", "station").agg(
        F.sum("kept").alias("datasets"), F.sum((F.col("kept") > 0).cast("long")).alias("places"), F.sum((F.col("gases") >= 2).cast("long")).alias("paired"),
        F.array_join(F.sort_array(F.collect_set("region")), ";").alias("regions"))


def weighted_mean(value: str, weight: str, ok: Column) -> Column:
    use = ok & F.col(value).isNotNull() & (F.col(weight) > 0)
    return F.try_divide(F.sum(F.when(use, F.col(value) * F.col(weight))), F.sum(F.when(use, F.col(weight)).cast("double")))


def bad_runs(dense: DataFrame, key: list[str], threshold: float) -> DataFrame:
    """Qualified months, months without any day, and the longest run that misses the threshold; clustered from 3 on."""
    w = Window.partitionBy(*key).orderBy("mo")
    d = dense.withColumn("bad", F.col("coverage") < threshold)
    d = d.withColumn("_c", F.coalesce((F.col("bad") != F.lag("bad").over(w)).cast("long"), F.lit(0)))
    d = d.withColumn("run", F.sum("_c").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    runs = d.groupBy(*key, "run").agg(F.sum(F.col("bad").cast("long")).alias("bad"), F.count(F.lit(1)).alias("months"), F.sum((F.col("days") == 0).cast("long")).alias("zero"))
    return runs.groupBy(*key).agg(
        (F.sum("months") - F.sum("bad")).alias("qualified_months"), F.sum("zero").alias("zero_months"), F.max("bad").alias("longest_bad"),
        (F.max("bad") >= 3).alias("clustered"))
