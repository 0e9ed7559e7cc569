"""Ordered sequences: islands, longest segments, blocks, lags, ranks and winners."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skytally.operators.skew import positions, previous, running_sum

#: Steps per bucket in which the rows of a key of any size are numbered.
BUCKET = 4096


def islands_by_step(df: DataFrame, key: list[str], at: str, step: int = 1, out: str = "run") -> DataFrame:
    """Number the runs in which ``at`` rises by exactly ``step``: value minus row number is constant inside one."""
    w = Window.partitionBy(*key).orderBy(at)
    return df.withColumn(out, F.col(at) - step * F.row_number().over(w))


def _bucket(at: str) -> Column:
    return F.floor(F.col(at) / BUCKET).cast("long")


def long_islands_by_step(df: DataFrame, key: str, at: str, out: str = "run") -> DataFrame:
    """islands_by_step for keys of any size: rows are numbered through buckets, so none has to fit a task."""
    return positions(df, key, _bucket(at), [at], "_pos").withColumn(out, F.col(at) - F.col("_pos") - 1).drop("_pos")


def islands_by_change(df: DataFrame, key: str, at: str, flag: Column, out: str = "run") -> DataFrame:
    """Number the runs of one value of ``flag`` from 0, in order of ``at``, for keys of any size."""
    d = previous(df.withColumn("_f", flag), key, _bucket(at), [at], ["_f"], "_p")
    d = d.withColumn("_c", F.coalesce((F.col("_f") != F.col("_p._f")).cast("long"), F.lit(0)))
    return running_sum(d, key, _bucket(at), [at], "_c", "_before").withColumn(out, F.col("_before") + F.col("_c")).drop("_f", "_p", "_c", "_before")


def longest_segment(df: DataFrame, key: str, at: str, limit: int) -> DataFrame:
    """Rows of each key's longest run of unit steps, the first on ties, cut to its centred ``limit`` rows, with ``pos`` from 0.

    Rows are numbered through buckets and runs then meet as sums, so no key has to fit a task.
    """
    runs = long_islands_by_step(df, key, at)
    sizes = runs.groupBy(key, "run").agg(F.count(F.lit(1)).alias("length"), F.min(at).alias("start"))
    best = sizes.groupBy(key).agg(F.max_by(F.struct("start", "length"), F.struct("length", -F.col("start"))).alias("b"))
    best = best.select(key, F.col("b.start").alias("_start"), F.col("b.length").alias("_length"))
    cut = best.withColumn("_from", F.col("_start") + F.floor(F.greatest(F.col("_length") - limit, F.lit(0)) / 2))
    cut = cut.withColumn("_to", F.col("_from") + F.least(F.col("_length"), F.lit(limit)) - 1)
    return (df.join(cut, key).where(F.col(at).between(F.col("_from"), F.col("_to")))
            .withColumn("pos", (F.col(at) - F.col("_from")).cast("long")).drop("_start", "_length", "_from", "_to"))


def candidate_blocks(df: DataFrame, key: list[str], at: str, length: int) -> DataFrame:
    """Start of every ``length``-step block that lies wholly inside one run."""
    runs = islands_by_step(df, key, at).groupBy(*key, "run").agg(F.min(at).alias("first"), F.max(at).alias("last"))
    runs = runs.where(F.col("last") - F.col("first") + 1 >= length)
    return runs.select(*key, F.explode(F.sequence("first", F.col("last") - length + 1)).alias("start"))


def average_rank(value: str, key: list[str]) -> Column:
    """Rank from 1 in which ties share their mean rank."""
    return F.rank().over(Window.partitionBy(*key).orderBy(value)) + (F.count(F.lit(1)).over(Window.partitionBy(*key, value)) - 1) / F.lit(2.0)


def spearman(df: DataFrame, key: list[str], x: str, y: str) -> DataFrame:
    """Rank correlation over rows in which both are known."""
    both = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    ranked = both.withColumns({"_rx": average_rank(x, key), "_ry": average_rank(y, key)})
    return ranked.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.corr("_rx", "_ry").alias("rho"))


def pick_with_tolerance(df: DataFrame, key: list[str], rules: list[tuple[str, str]], name: str, tolerance: float) -> DataFrame:
    """One row per key: rule by rule keep what lies within ``tolerance`` of the best, at last the first by name.

    Not the same as an ORDER BY: a row slightly worse on one rule may win on the next.
    """
    w = Window.partitionBy(*key)
    for column, best in rules:
        edge = (F.max if best == "max" else F.min)(column).over(w)
        df = df.withColumn("_e", edge).where(F.abs(F.col(column) - F.col("_e")) <= tolerance).drop("_e")
    return df.withColumn("_r", F.row_number().over(w.orderBy(name))).where("_r = 1").drop("_r")


def top_rows(df: DataFrame, key: list[str], order: list, n: int) -> DataFrame:
    """The first n rows of each key."""
    w = Window.partitionBy(*key).orderBy(*order)
    return df.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= n)


def head_rows(df: DataFrame, key: str, bucket: Column, order: list, n: int) -> DataFrame:
    """top_rows for keys of any size: rows are numbered through buckets, see skew.positions."""
    return positions(df, key, bucket, order, "_pos").where(F.col("_pos") < n).withColumn("rn", (F.col("_pos") + 1).cast("int")).drop("_pos")


def farthest_points(sites: DataFrame, key: str, name: str, lat: str, lon: str, weight: str, n: int) -> DataFrame:
    """Greedy spread of n sites per key.

    The first is the one of most weight, then by name; each next one is farthest from those
    chosen (latitude/90 and wrapped longitude/180), ties by weight, then by name. Each
    round is one aggregation and one join over all sites; nothing is gathered per key.
    """
    sites = sites.select(key, name, lat, lon, weight)
    first = sites.groupBy(key).agg(F.min_by(F.struct(name, lat, lon), F.struct(-F.col(weight), name)).alias("s"))
    chosen = first.select(key, F.lit(1).alias("place"), "s.*")
    left = sites.withColumn("near", F.lit(float("inf")))
    last = chosen
    for k in range(2, n + 1):
        prev = last.select(F.col(key).alias("_k"), F.col(name).alias("_name"), F.col(lat).alias("_lat"), F.col(lon).alias("_lon"))
        dlon = F.abs(F.col(lon) - F.col("_lon"))
        dist = F.sqrt(F.pow((F.col(lat) - F.col("_lat")) / 90, 2) + F.pow(F.least(dlon, 360 - dlon) / 180, 2))
        left = (left.join(prev, F.col(key) == F.col("_k")).where(F.col(name) != F.col("_name"))
                .withColumn("near", F.round(F.least("near", dist), 12)).drop("_k", "_name", "_lat", "_lon"))
        last = left.groupBy(key).agg(F.min_by(F.struct(name, lat, lon), F.struct(-F.col("near"), -F.col(weight), name)).alias("s")).select(key, F.lit(k).alias("place"), "s.*")
        chosen = chosen.unionByName(last)
    return chosen
