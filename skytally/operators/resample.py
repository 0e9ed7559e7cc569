"""Repeatable resampling: every draw is a hash of its name, so any engine and any retry gives the same."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skytally.functions.columns import hash_draw


def seed(*parts: object) -> int:
    """A 63-bit seed from named parts."""
    return int.from_bytes(hashlib.sha256("|".join(map(str, parts)).encode()).digest()[:8], "big") >> 1


def replicates(sizes: DataFrame, n: str, count: int, *scope: Column | str) -> DataFrame:
    """``count`` replicates of n draws with replacement from 0..n-1 for every row of ``sizes``: adds rep, slot, draw."""
    d = sizes.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(count - 1)))).withColumn("slot", F.explode(F.sequence(F.lit(0), (F.col(n) - 1).cast("int"))))
    return d.withColumn("draw", hash_draw(F.col(n), *scope, F.col("rep").cast("string"), F.col("slot").cast("string")))


def bootstrap_statistic(values: DataFrame, key: list[str], order: str, value: str, count: int, scope: str, statistic: Column) -> DataFrame:
    """A statistic of each replicate; ``statistic`` is an aggregate over column x. Keys are small tables of blocks or folds."""
    w = Window.partitionBy(*key).orderBy(order)
    members = values.select(*key, (F.row_number().over(w) - 1).cast("long").alias("draw"), F.col(value).alias("x"))
    sizes = members.groupBy(*key).agg(F.count(F.lit(1)).alias("size"))
    draws = replicates(sizes, "size", count, scope, *[F.col(k).cast("string") for k in key])
    return draws.join(members, [*key, "draw"]).groupBy(*key, "rep").agg(statistic.alias("stat"))


def interval(stats: DataFrame, key: list[str], sizes: DataFrame | None = None, least: int = 0) -> DataFrame:
    """2.5 and 97.5 percentiles; withheld where a key has fewer than ``least`` members."""
    g = stats.groupBy(*key).agg(F.percentile("stat", F.array(F.lit(0.025), F.lit(0.975))).alias("q"), F.count(F.lit(1)).alias("reps"))
    if sizes is not None:
        g = g.join(sizes.select(*key, "size"), key)
        return g.select(*key, "reps", "size", F.when(F.col("size") >= least, F.col("q")[0]).alias("low"), F.when(F.col("size") >= least, F.col("q")[1]).alias("high"))
    return g.select(*key, "reps", F.col("q")[0].alias("low"), F.col("q")[1].alias("high"))


def moving_block_sample(residuals: DataFrame, key: list[str], mo: str, value: str, length: int, count: int, scope: str) -> DataFrame:
    """Moving-block bootstrap that never bridges a missing month.

    Each observed run is cut into chunks of ``length``; a chunk takes the first values of a
    drawn block of ``length`` months that lies wholly inside one run. Result: key, rep, mo, value.
    """
    from skytally.operators.sequences import candidate_blocks, islands_by_step

    blocks = candidate_blocks(residuals.select(*key, mo), key, mo, length)
    w = Window.partitionBy(*key).orderBy("start")
    blocks = blocks.select(*key, "start", (F.row_number().over(w) - 1).cast("long").alias("draw"))
    sizes = blocks.groupBy(*key).agg(F.count(F.lit(1)).alias("size"))
    runs = islands_by_step(residuals.select(*key, mo), key, mo)
    chunk = F.floor((F.row_number().over(Window.partitionBy(*key, "run").orderBy(mo)) - 1) / length)
    placed = runs.withColumn("inside", F.pmod(F.row_number().over(Window.partitionBy(*key, "run").orderBy(mo)) - 1, F.lit(length))).withColumn("chunk", chunk)
    first = placed.groupBy(*key, "run", "chunk").agg(F.min(mo).alias("chunk_start"))
    draws = first.join(sizes, key).withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(count - 1))))
    draws = draws.withColumn("draw", hash_draw(F.col("size"), scope, *[F.col(k).cast("string") for k in key], F.col("rep").cast("string"), F.col("chunk_start").cast("string")))
    targets = placed.join(draws.join(blocks, [*key, "draw"]).select(*key, "run", "chunk", "rep", "start"), [*key, "run", "chunk"])
    source = residuals.select(*key, F.col(mo).alias("_from"), F.col(value).alias("sample"))
    return targets.withColumn("_from", F.col("start") + F.col("inside")).join(source, [*key, "_from"]).select(*key, "rep", mo, "sample")


def inject_spikes(df: DataFrame, key: list[str], pos: str, value: str, share: int, size: Column, margin: int, scope: str) -> DataFrame:
    """Add +-10 scales at max(20, n/share) positions drawn by hash order inside the margins; adds injected and truth."""
    n = df.groupBy(*key).agg(F.count(F.lit(1)).alias("_n"))
    d = df.join(n, key).withColumn("_h", F.sha2(F.concat_ws("|", F.lit(scope), *[F.col(k).cast("string") for k in key], F.col(pos).cast("string")), 256))
    inside = (F.col(pos) >= margin) & (F.col(pos) < F.col("_n") - margin)
    d = d.withColumn("_r", F.row_number().over(Window.partitionBy(*key, inside).orderBy("_h")))
    truth = inside & (F.col("_r") <= F.greatest(F.lit(20), F.floor(F.col("_n") / share)))
    sign = F.when(F.substring("_h", 64, 1).isin(*"02468ace"), 1.0).otherwise(-1.0)
    return d.withColumns({"truth": truth, "injected": F.col(value) + F.when(truth, sign * 10 * size).otherwise(0.0)}).drop("_n", "_h", "_r")


#: Events of the reference: rows changed at once, scales added, margins before and after a start, least count.
EVENTS = {
    "positive_spikes": (1, 10.0, 50, 50), "negative_spikes": (1, -10.0, 50, 50),
    "positive_shift": (6, 6.0, 100, 110), "negative_shift": (6, -6.0, 100, 110), "season_dependent_positive": (1, 8.0, 0, 0),
}


def inject_events(df: DataFrame, key: str, pos: str, h: str, value: str, repetitions: int, scope: str) -> DataFrame:
    """Every event in every repetition, put into a copy of each key's series: key, event, repetition, pos, h, value, injected, truth.

    n is a hundredth of the rows, 20 at least. Spikes and seasonal events stand at n positions, shifts begin
    at max(3, n / 2), and where shifts overlap they add up. Positions come in hash order, inside the event's margins; the seasonal
    event takes January, February, July and August. The scale is max(MAD of differences, MAD / 20, 1e-3).
    A series without a position keeps its values and has no truth.
    """
    from skytally.operators.rolling import mad

    rows = df.select(key, pos, h, value)
    step = rows.withColumn("_d", F.col(value) - F.lag(value).over(Window.partitionBy(key).orderBy(pos)))
    size = mad(rows, [key], value).withColumnRenamed("mad", "_m").join(mad(step, [key], "_d").withColumnRenamed("mad", "_s"), key, "left")
    n = rows.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).withColumn("_k", F.greatest(F.lit(20), F.floor(F.col("_n") / 100)))
    rows = rows.join(n.join(size, key).withColumn("_scale", F.greatest(F.col("_s"), F.col("_m") * 0.05, F.lit(1e-3))).drop("_m", "_s"), key)
    event = F.inline(F.array(*[F.struct(F.lit(e).alias("event"), F.lit(w).alias("_w"), F.lit(a).alias("_a"), F.lit(lo).alias("_lo"), F.lit(hi).alias("_hi")) for e, (w, a, lo, hi) in EVENTS.items()]))
    d = rows.select("*", event).withColumn("repetition", F.explode(F.sequence(F.lit(1), F.lit(repetitions))))
    month = F.month(F.timestamp_seconds(F.col(h) * 3600))
    inside = (F.col(pos) >= F.col("_lo")) & (F.col(pos) < F.col("_n") - F.col("_hi")) & ((F.col("event") != "season_dependent_positive") | month.isin(1, 2, 7, 8))
    most = F.when(F.col("_w") > 1, F.greatest(F.lit(3), F.floor(F.col("_k") / 2))).otherwise(F.col("_k"))
    series = [key, "event", "repetition"]
    d = d.withColumns({"_in": inside, "_h": F.sha2(F.concat_ws("|", F.lit(scope), key, "event", "repetition", pos), 256)})
    d = d.withColumn("_start", (F.col("_in") & (F.row_number().over(Window.partitionBy(*series, "_in").orderBy("_h")) <= most)).cast("int"))
    back = lambda k: F.sum("_start").over(Window.partitionBy(*series).orderBy(pos).rowsBetween(-k, 0))
    d = d.withColumn("_hits", F.when(F.col("_w") > 1, back(5)).otherwise(F.col("_start")))
    return d.select(*series, pos, h, value, (F.col(value) + F.col("_hits") * F.col("_a") * F.col("_scale")).alias("injected"), (F.col("_hits") > 0).alias("truth"))


def disjoint_placements(df: DataFrame, key: list[str], pos: str, n: str, length: int, low: int, high: int, most: int, scope: str) -> DataFrame:
    """Up to ``most`` disjoint stretches per key: feasible starts in hash order, each kept if no kept one overlaps it.

    Greedy choice depends on order, so starts are thinned first: a start that is the first in
    hash order among all starts it overlaps is kept outright, round after round, which is the
    same set as the sequential pass. Each round is one window over positions.
    """
    d = df.where((F.col(pos) > low) & (F.col(pos) < F.col(n) - high)).select(*key, F.col(pos).alias("start"))
    left = d.withColumn("h", F.sha2(F.concat_ws("|", F.lit(scope), *[F.col(k).cast("string") for k in key], F.col("start").cast("string")), 256))
    w = Window.partitionBy(*key).orderBy("start").rangeBetween(-(length - 1), length - 1)
    kept = None
    for _ in range(most):
        marked = left.withColumn("take", F.col("h") == F.min("h").over(w))
        taken = marked.where("take").select(*key, "start", "h")
        kept = taken if kept is None else kept.unionByName(taken)
        left = marked.withColumn("near", F.max("take").over(w)).where(~F.col("near")).select(*key, "start", "h")
    order = Window.partitionBy(*key).orderBy("h")
    return kept.withColumn("placement", F.row_number().over(order)).where(F.col("placement") <= most).select(*key, "placement", "start")


GAP_HOURS = (1, 3, 6, 12, 24, 48, 72)
SEASONS = ("DJF", "MAM", "JJA", "SON")


def season_placements(df: DataFrame, key: str, pos: str, h: str, scope: str, most: int = 20, low: int = 200, high: int = 300) -> DataFrame:
    """Artificial gaps per key, season and length: key, season, gap_hours, placement, start, and h of the start.

    Starts lie in the season, beyond ``low`` and before the last ``high`` rows. Placement 0 is the anchor, the middle one of them, at
    least low rows and the gap before the end; 1.. are the first ``most`` others in hash order that overlap neither the anchor nor each
    other. A key is one bounded segment (see sequences.longest_segment).
    """
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(pos)
        name, at, n = pdf[key].iloc[0], pdf[h].to_numpy(), len(pdf)
        season = (pd.to_datetime(at * 3600, unit="s").month.to_numpy() % 12) // 3
        out = []
        for k, label in enumerate(SEASONS):
            pool = np.flatnonzero(season == k)
            pool = pool[(pool > low) & (pool < n - high)]
            for length in GAP_HOURS if len(pool) else ():
                kept = [min(int(pool[len(pool) // 2]), n - length - low)]
                for q in sorted(pool.tolist(), key=lambda q, k=label, g=length: hashlib.sha256(f"{scope}|{name}|{k}|{g}|{q}".encode()).digest()):
                    if len(kept) > most:
                        break
                    if all(abs(q - p) >= length for p in kept):
                        kept.append(q)
                out += [(name, label, length, i, q, int(at[q])) for i, q in enumerate(kept)]
        return pd.DataFrame(out, columns=[key, "season", "gap_hours", "placement", "start", "h"])

    types = dict(df.dtypes)
    return df.select(key, pos, h).groupBy(key).applyInPandas(run, f"`{key}` {types[key]}, season string, gap_hours int, placement int, start long, h long")
