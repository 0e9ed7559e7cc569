"""Problem 1: irregular readings onto a regular hourly grid."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skytally.sources.tables import good_reading

HOUR_US = 3_600_000_000
#: Hours per block. A record's hours are cut into blocks so that no task holds a whole record.
BLOCK_HOURS = 1024


def regular_grid(obs: DataFrame, gap_limit_hours: float = 6.0, block_hours: int = BLOCK_HOURS) -> DataFrame:
    """One row per record and full UTC hour from the first to the last good reading.

    As-of merge: the sorted grid and the sorted hourly readings of a (record, block) are
    merged and each grid hour takes its nearest readings on both sides; the readings just
    outside a block come from per-block summaries. An hour without a reading gets the
    time-weighted linear value at its middle if the two neighbours lie at most
    ``gap_limit_hours`` apart. Readings are exchanged once, by record and block; grid hours
    come into being behind that exchange and are never shuffled.

    Columns: record_id, hour_epoch (hour's start, Unix seconds), n_readings, value, status
    (observed, filled, missing), previous_epoch, next_epoch (neighbouring readings).

    Defined cases: rows with null value, instant, record or qc_valid are no readings; several
    deliveries of one instant count as the one received last (then the highest row_id); ties
    in all of that change nothing; n_readings counts instants; an empty table gives no rows;
    other columns of the input are ignored.
    """
    good = obs.where(good_reading() & F.col("record_id").isNotNull()).select(
        "record_id", F.unix_micros("timestamp_utc").alias("us"), "value", "received_at", "row_id")
    # one exchange of the readings; all that follows inside a block keeps its partitioning
    placed = good.withColumn("block", F.floor(F.col("us") / (HOUR_US * block_hours)).cast("long"))
    placed = placed.where("block is not null").repartition("record_id", "block")  # the filter a join would add; with it both readers share the exchange
    latest = placed.groupBy("record_id", "block", "us").agg(
        F.max_by("value", F.struct("received_at", "row_id", "value")).alias("value"))
    hours = (latest.withColumn("h", F.floor(F.col("us") / HOUR_US).cast("long"))
             .groupBy("record_id", "block", "h").agg(
                 F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"),
                 F.min("us").alias("first_us"), F.min_by("value", "us").alias("first_v"),
                 F.max("us").alias("last_us"), F.max_by("value", "us").alias("last_v")))

    ends = hours.groupBy("record_id", "block").agg(
        F.min("h").alias("h0"), F.max("h").alias("h1"),
        F.min("first_us").alias("in_us"), F.min_by("first_v", "first_us").alias("in_v"),
        F.max("last_us").alias("out_us"), F.max_by("last_v", "last_us").alias("out_v"))
    w = Window.partitionBy("record_id").orderBy("block")
    ends = ends.select(
        "*", F.lag("block").over(w).isNull().alias("is_first"), F.lead("block").over(w).alias("next_block"),
        F.lag("out_us").over(w).alias("prev_us"), F.lag("out_v").over(w).alias("prev_v"),
        F.lead("in_us").over(w).alias("next_us"), F.lead("in_v").over(w).alias("next_v"))
    spans = ends.withColumn("b", F.explode(F.sequence("block", F.coalesce(F.col("next_block") - 1, F.col("block")))))
    empty = F.col("b") > F.col("block")
    spans = spans.select(
        "record_id", F.col("b").alias("block"),
        F.when(empty | ~F.col("is_first"), F.col("b") * block_hours).otherwise(F.col("h0")).alias("from_h"),
        F.when(F.col("next_block").isNull(), F.col("h1")).otherwise(F.col("b") * block_hours + block_hours - 1).alias("to_h"),
        F.when(empty, F.col("out_us")).otherwise(F.col("prev_us")).alias("carry_prev_us"),
        F.when(empty, F.col("out_v")).otherwise(F.col("prev_v")).alias("carry_prev_v"),
        F.col("next_us").alias("carry_next_us"), F.col("next_v").alias("carry_next_v"))

    # the merge: a sorted reading hour takes the grid hours from its own to the one before the next
    # reading hour, the first of a block also those before it; a block without readings takes all of its hours
    inside = Window.partitionBy("record_id", "block").orderBy("h")
    runs = spans.join(hours, ["record_id", "block"], "left").select(
        "*", F.coalesce(F.lag("last_us").over(inside), "carry_prev_us").alias("back_us"),
        F.coalesce(F.lag("last_v").over(inside), "carry_prev_v").alias("back_v"),
        F.coalesce(F.lead("first_us").over(inside), "carry_next_us").alias("ahead_us"),
        F.coalesce(F.lead("first_v").over(inside), "carry_next_v").alias("ahead_v"),
        F.when(F.lag("h").over(inside).isNull(), F.col("from_h")).otherwise(F.col("h")).alias("run_from"),
        F.coalesce(F.lead("h").over(inside) - 1, "to_h").alias("run_to"))
    merged = runs.withColumn("g", F.explode(F.sequence("run_from", "run_to")))
    own, after, before = F.col("g") == F.col("h"), F.col("g") > F.col("h"), F.col("g") < F.col("h")
    merged = merged.select(
        "record_id", "g", F.when(own, F.col("n")).alias("n"), "mean",
        F.when(after, F.col("last_us")).otherwise(F.col("back_us")).alias("t0"), F.when(after, F.col("last_v")).otherwise(F.col("back_v")).alias("v0"),
        F.when(before, F.col("first_us")).otherwise(F.col("ahead_us")).alias("t1"), F.when(before, F.col("first_v")).otherwise(F.col("ahead_v")).alias("v1"))
    middle = F.col("g") * HOUR_US + HOUR_US // 2
    near = (F.col("t1") - F.col("t0")) <= F.lit(int(gap_limit_hours * HOUR_US))
    linear = F.col("v0") + (F.col("v1") - F.col("v0")) * ((middle - F.col("t0")) / (F.col("t1") - F.col("t0")))
    return merged.select(
        "record_id", (F.col("g") * 3600).alias("hour_epoch"), F.coalesce("n", F.lit(0)).alias("n_readings"),
        F.when(F.col("n").isNotNull(), F.col("mean")).when(near, linear).alias("value"),
        F.when(F.col("n").isNotNull(), "observed").when(near, "filled").otherwise("missing").alias("status"),
        F.floor(F.col("t0") / 1_000_000).cast("long").alias("previous_epoch"),
        F.floor(F.col("t1") / 1_000_000).cast("long").alias("next_epoch"))


def empty_hours(obs: DataFrame) -> DataFrame:
    """The grid hours in which no good reading lies: those that the merge filled from their neighbours or marked missing."""
    return regular_grid(obs).where(F.col("status").isin("filled", "missing")).select("record_id", "hour_epoch")
