"""Problem 4: exact percentiles per group by distributed multi-select, from daily states that combine."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skytally.operators.skew import BROADCAST_ROWS
from skytally.session import written

METRICS = ("median_rmse", "median_mae")
KEYS = ("gas", "method", "gap_hours")
QUANTILES = (0.05, 0.25, 0.5, 0.75, 0.95)
#: Rounds after which something is wrong: a pivot discards a quarter of a range's weight at least, so 2**64 readings need fewer.
MAX_ROUNDS = 160
#: Open values are written anew once they are under this share of what is scanned.
SHRINK = 0.5


def daily_states(summary: DataFrame, metrics: tuple[str, ...] = METRICS, keys: tuple[str, ...] = KEYS, day: str = "run_day") -> DataFrame:
    """What one day contributes: each distinct value of each group and metric with its count.

    States of any set of days combine by addition, without any error: (day, keys..., metric,
    value, n). Null and NaN values are left out; rows with null keys or day form groups of
    their own; repeated rows count as often as they stand.
    """
    pairs = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics])
    rows = summary.select(F.col(day).alias("day"), *keys, F.inline(pairs)).where(F.col("value").isNotNull() & ~F.isnan("value"))
    # 0.0 and -0.0 are one value
    return rows.withColumn("value", F.col("value") + F.lit(0.0)).groupBy("day", *keys, "metric", "value").agg(F.count(F.lit(1)).alias("n"))


def _propose(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The weighted median of each range within a batch, with the weight it stands for."""
    for pdf in batches:
        pdf = pdf.sort_values(["range_id", "value"])
        starts = np.flatnonzero(np.r_[True, pdf["range_id"].to_numpy()[1:] != pdf["range_id"].to_numpy()[:-1]]) if len(pdf) else []
        ids, values, weights = pdf["range_id"].to_numpy(), pdf["value"].to_numpy(), pdf["n"].to_numpy()
        rows = []
        for a, b in zip(starts, [*starts[1:], len(pdf)]):
            c = np.cumsum(weights[a:b])
            rows.append((ids[a], values[a + int(np.searchsorted(c * 2, c[-1]))], int(c[-1])))
        yield pd.DataFrame(rows, columns=["range_id", "proposal", "weight"])


class _Meeting:
    """Values beside the open ranges of their group: broadcast while the ranges, of which there are never more than wanted ranks, are few, else salted."""

    def __init__(self, wanted: DataFrame, salts: int = 32):
        self.salts = 0 if wanted.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else salts

    def __call__(self, values: DataFrame, ranges: DataFrame, *columns: str) -> DataFrame:
        """Each value with the range that it lies strictly inside of; ranges of a group don't overlap."""
        bounds = ranges.select("gid", "range_id", "lower", "upper", *columns)
        inside = (F.col("lower").isNull() | (F.col("value") > F.col("lower"))) & (F.col("upper").isNull() | (F.col("value") < F.col("upper")))
        if not self.salts:
            return values.join(F.broadcast(bounds), "gid").where(inside)
        bounds = bounds.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(self.salts - 1))))
        salted = values.withColumn("salt", F.pmod(F.xxhash64("value"), F.lit(self.salts)).cast("int"))
        return salted.join(bounds, ["gid", "salt"]).where(inside).drop("salt")


def select_ranks(values: DataFrame, wanted: DataFrame, log: list[int] | None = None) -> DataFrame:
    """Exact order statistics. values: gid, value, n. wanted: gid, rank (from 0). Result: gid, rank, value.

    Every open range proposes: each task's batches give their weighted local medians, their
    weighted median becomes the range's pivot, values are counted three ways against it and
    the range splits into what the wanted ranks still need, round after round, until every
    rank is a pivot. Values outside all open ranges are left behind. ``log`` receives the
    number of open ranges of each round.
    """
    meet = _Meeting(wanted)
    ranges = written(wanted.groupBy("gid").agg(F.sort_array(F.collect_set("rank")).alias("ranks")).select(
        "gid", F.monotonically_increasing_id().alias("range_id"), "ranks", F.lit(None).cast("double").alias("lower"),
        F.lit(None).cast("double").alias("upper"), F.lit(0).cast("long").alias("below")))
    answers: list[DataFrame] = []
    open_, scanned = ranges.count(), None
    for _ in range(MAX_ROUNDS):
        if not open_:
            break
        if log is not None:
            log.append(open_)
        inside = meet(values, ranges).select("range_id", "value", "n")
        proposals = inside.mapInPandas(_propose, "range_id long, proposal double, weight long").groupBy("range_id", "proposal").agg(F.sum("weight").alias("weight"))
        order = Window.partitionBy("range_id").orderBy("proposal").rowsBetween(Window.unboundedPreceding, 0)
        cumulative = proposals.withColumns({"c": F.sum("weight").over(order), "all": F.sum("weight").over(Window.partitionBy("range_id"))})
        pivots = cumulative.where(F.col("c") * 2 >= F.col("all")).groupBy("range_id").agg(F.min("proposal").alias("pivot"))
        counted = meet(values, ranges.join(pivots, "range_id"), "pivot").groupBy("range_id", "pivot").agg(
            F.sum(F.when(F.col("value") < F.col("pivot"), F.col("n")).otherwise(0)).alias("less"),
            F.sum(F.when(F.col("value") == F.col("pivot"), F.col("n")).otherwise(0)).alias("same"),
            F.sum((F.col("value") < F.col("pivot")).cast("long")).alias("size_less"),
            F.sum((F.col("value") > F.col("pivot")).cast("long")).alias("size_more"))
        start = F.col("below") + F.col("less")
        stop = start + F.col("same")
        parts = F.array(
            F.struct(F.lit(-1).alias("side"), F.filter("ranks", lambda r: r < start).alias("ranks"), F.col("lower").alias("lower"), F.col("pivot").alias("upper"), F.col("below").alias("below"), F.col("size_less").alias("size")),
            F.struct(F.lit(0).alias("side"), F.filter("ranks", lambda r: (r >= start) & (r < stop)).alias("ranks"), F.col("pivot").alias("lower"), F.col("pivot").alias("upper"), start.alias("below"), F.lit(0).cast("long").alias("size")),
            F.struct(F.lit(1).alias("side"), F.filter("ranks", lambda r: r >= stop).alias("ranks"), F.col("pivot").alias("lower"), F.col("upper").alias("upper"), stop.alias("below"), F.col("size_more").alias("size")))
        split = written(ranges.select("gid", "range_id", "ranks", "lower", "upper", "below").join(counted, "range_id").select("gid", F.inline(parts))
                    .where(F.size("ranks") > 0).withColumn("range_id", F.monotonically_increasing_id()))
        answers.append(split.where("side = 0").select("gid", F.explode("ranks").alias("rank"), F.col("lower").alias("value")))
        ranges = split.where("side <> 0")
        open_, left = ranges.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()
        if open_ and (scanned is None or left < SHRINK * scanned):
            values, scanned = written(meet(values, ranges).select("gid", "value", "n")), left
    else:
        raise RuntimeError(f"ranges still open after {MAX_ROUNDS} rounds")
    return reduce(DataFrame.unionByName, answers) if answers else wanted.select("gid", "rank", F.lit(None).cast("double").alias("value"))


def group_ids(values: DataFrame, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """(values with a number ``gid`` per group instead of ``columns``, groups with their gid).

    The number is a hash; if two groups should share one, the next seed is tried.
    """
    groups = written(values.groupBy(*columns).agg(F.sum("n").alias("total")))
    for seed in range(8):
        gid = F.xxhash64(F.lit(seed), *[x for c in columns for x in (F.col(c).isNull(), F.col(c))])
        named = groups.withColumn("gid", gid)
        if named.groupBy("gid").agg(F.count(F.lit(1)).alias("k")).where("k > 1").isEmpty():
            return values.select(gid.alias("gid"), *[c for c in values.columns if c not in columns]), named
    raise RuntimeError("no seed gives every group a number of its own")


def combine(states: DataFrame, quantiles: tuple[float, ...] = QUANTILES, keys: tuple[str, ...] = KEYS, log: list[int] | None = None) -> DataFrame:
    """Percentiles per group and metric over the days whose states are given.

    Columns: keys..., metric, n, quantile, value, error. value interpolates linearly between
    the two order statistics around quantile * (n - 1), both found exactly, so error (the
    largest possible deviation) is 0. An empty table gives no rows.
    """
    values, groups = group_ids(states.groupBy(*keys, "metric", "value").agg(F.sum("n").alias("n")), [*keys, "metric"])
    values = written(values)
    ranked = groups.withColumn("quantile", F.explode(F.array(*[F.lit(float(q)) for q in quantiles])))
    place = F.col("quantile") * (F.col("total") - 1)
    ranked = ranked.withColumns({"low": F.floor(place), "high": F.ceil(place), "share": place - F.floor(place)})
    wanted = ranked.select("gid", F.explode(F.array("low", "high")).alias("rank")).distinct()
    found = select_ranks(values, wanted, log)
    low, high = found.toDF("gid", "low", "low_value"), found.toDF("gid", "high", "high_value")
    both = ranked.join(low, ["gid", "low"]).join(high, ["gid", "high"])
    value = F.when(F.col("share") == 0, F.col("low_value")).otherwise(
        F.col("low_value") + (F.col("high_value") - F.col("low_value")) * F.col("share"))
    return both.select(*keys, "metric", F.col("total").alias("n"), "quantile", value.alias("value"), F.lit(0.0).alias("error"))
