"""Joins and positional blocks that hold when one key has a third of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skytally.session import cut, standing

#: A side is broadcast only when it has been counted and has at most so many rows.
BROADCAST_ROWS = 50_000


def join_dimension(facts: DataFrame, dim: DataFrame, keys: list[str], how: str = "left",
                   max_rows: int = BROADCAST_ROWS, salts: int = 32) -> DataFrame:
    """Join a large table to one with unique ``keys``.

    ``dim`` is materialised in the shared folder (unless it already stands there) and counted. Up to ``max_rows`` rows it is
    broadcast. Beyond that the join shuffles, with every dimension row repeated once per
    salt so that no fact key has to fit one task. Null keys match nothing and stay in the
    result of a left join; they carry a salt of their own row and so spread as well.
    """
    if not standing(dim):
        dim = cut(dim)
    if dim.limit(max_rows + 1).count() <= max_rows:
        return facts.join(F.broadcast(dim), keys, how)
    salted = dim.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    spread = facts.withColumn("_salt", F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in facts.columns]), F.lit(salts)).cast("int"))
    return spread.join(salted, [*keys, "_salt"], how).drop("_salt")


def positions(df: DataFrame, key: str, bucket: Column, order: list[str], out: str = "pos") -> DataFrame:
    """Number the rows of each key 0, 1, ... in ``order`` without sorting a key in one task.

    ``bucket`` must be monotone in ``order`` and send ties to one bucket. Rows are numbered
    inside (key, bucket); the start of each bucket comes from a running sum over bucket
    counts, which are few.
    """
    df = df.withColumn("_bucket", bucket)
    counts = df.groupBy(key, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(key).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(key, "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy(key, "_bucket").orderBy(*order)
    numbered = df.withColumn("_rn", F.row_number().over(inside))
    return (numbered.join(starts, [key, "_bucket"])
            .withColumn(out, F.col("_start") + F.col("_rn") - 1).drop("_bucket", "_start", "_rn"))


def running_sum(df: DataFrame, key: str, bucket: Column, order: list[str], value: str, out: str) -> DataFrame:
    """Sum of a whole-numbered ``value`` over the rows of the key that come before, without sorting a key in one task; see positions."""
    df = df.withColumn("_bucket", bucket)
    sums = df.groupBy(key, "_bucket").agg(F.sum(value).alias("_n"))
    before = Window.partitionBy(key).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(key, "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy(key, "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    summed = df.withColumn("_in", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    return summed.join(starts, [key, "_bucket"]).withColumn(out, F.col("_start") + F.col("_in")).drop("_bucket", "_start", "_in")


def previous(df: DataFrame, key: str, bucket: Column, order: list[str], columns: list[str], out: str = "prev") -> DataFrame:
    """Add the struct ``out`` of ``columns`` of the row before (null for a key's first), without sorting a key in one task; see positions.

    Inside a bucket the row before is a lag; a bucket's first row takes the last one of the bucket before it.
    """
    df = df.withColumn("_bucket", bucket)
    last = df.groupBy(key, "_bucket").agg(F.max_by(F.struct(*columns), F.struct(*order)).alias("_last"))
    carry = last.select(key, "_bucket", F.lag("_last").over(Window.partitionBy(key).orderBy("_bucket")).alias("_carry"))
    inside = Window.partitionBy(key, "_bucket").orderBy(*order)
    return (df.withColumn(out, F.lag(F.struct(*columns)).over(inside)).join(carry, [key, "_bucket"])
            .withColumn(out, F.coalesce(out, "_carry")).drop("_bucket", "_carry"))


def blocks_with_halo(df: DataFrame, pos: str, rows: int, halo: int) -> DataFrame:
    """Cut numbered rows into blocks of ``rows`` and lend each block ``halo`` rows of both neighbours.

    Adds ``block`` and ``core`` (true for the block's own rows). A row goes to at most three blocks.
    """
    if halo >= rows:
        raise ValueError("the halo must be shorter than a block")
    own = F.floor(F.col(pos) / rows).cast("long")
    inside = F.pmod(F.col(pos), F.lit(rows))
    shifts = F.array_compact(F.array(
        F.lit(0), F.when((inside < halo) & (own > 0), F.lit(-1)), F.when(inside >= rows - halo, F.lit(1))))
    return (df.withColumn("_shift", F.explode(shifts))
            .withColumn("block", own + F.col("_shift"))
            .withColumn("core", F.col("_shift") == 0).drop("_shift"))
