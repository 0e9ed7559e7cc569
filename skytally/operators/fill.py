"""Gap reconstruction: five methods, one-hour fills, resampling and the errors of a fill."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skytally.operators.skew import previous

METHODS = ("linear", "pchip", "local_level_kalman", "seasonal_median", "seasonal_residual_linear")


def _sides(key: list[str], at: str):
    w = Window.partitionBy(*key).orderBy(at)
    return w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(1, Window.unboundedFollowing)


def linear(df: DataFrame, key: list[str], at: str, value: str, out: str = "fill") -> DataFrame:
    """Known values stay; between two known ones the straight line by ``at``; beyond the ends the nearest known value."""
    back, ahead = _sides(key, at)
    known = F.when(F.col(value).isNotNull(), F.col(at))
    df = df.withColumns({"_t0": F.last(known, True).over(back), "_v0": F.last(value, True).over(back),
                         "_t1": F.first(known, True).over(ahead), "_v1": F.first(value, True).over(ahead)})
    line = F.col("_v0") + (F.col("_v1") - F.col("_v0")) * (F.col(at) - F.col("_t0")) / (F.col("_t1") - F.col("_t0"))
    return df.withColumn(out, F.coalesce(F.col(value), line, "_v0", "_v1")).drop("_t0", "_v0", "_t1", "_v1")


def _slope(h0: Column, d0: Column, h1: Column, d1: Column) -> Column:
    """Weighted harmonic mean of two secants; 0 where they differ in sign or one is 0."""
    w1, w2 = 2 * h1 + h0, h1 + 2 * h0
    return F.when((d0 * d1) <= 0, F.lit(0.0)).otherwise((w1 + w2) / (w1 / d0 + w2 / d1))


def pchip(df: DataFrame, key: list[str], at: str, value: str, out: str = "fill") -> DataFrame:
    """Shape-preserving cubic over interior gaps with two known points on each side; null elsewhere.

    Only those four anchors matter, so the curve is a closed form over columns.
    """
    known = df.where(F.col(value).isNotNull())
    w = Window.partitionBy(*key).orderBy(at)
    pair = F.struct(F.col(at).alias("t"), F.col(value).alias("v"), F.col("_ta").alias("ta"), F.col("_va").alias("va"),
                    F.lead(at).over(w).alias("tb"), F.lead(value).over(w).alias("vb"))
    known = known.withColumns({"_ta": F.lag(at).over(w), "_va": F.lag(value).over(w)}).withColumn("_p", pair).select(*key, at, "_p")
    back, ahead = _sides(key, at)
    d = df.join(known, [*key, at], "left").withColumns({"_l": F.last("_p", True).over(back), "_r": F.first("_p", True).over(ahead)})
    t0, v0, t1, v1 = F.col("_l.t"), F.col("_l.v"), F.col("_r.t"), F.col("_r.v")
    h = (t1 - t0).cast("double")
    ha, hb = (t0 - F.col("_l.ta")).cast("double"), (F.col("_r.tb") - t1).cast("double")
    secant, sa, sb = (v1 - v0) / h, (v0 - F.col("_l.va")) / ha, (F.col("_r.vb") - v1) / hb
    m0, m1 = _slope(ha, sa, h, secant), _slope(h, secant, hb, sb)
    s = (F.col(at) - t0) / h
    curve = ((1 + 2 * s) * (1 - s) * (1 - s) * v0 + s * (1 - s) * (1 - s) * h * m0 + s * s * (3 - 2 * s) * v1 + s * s * (s - 1) * h * m1)
    return d.withColumn(out, F.coalesce(F.col(value), curve)).drop("_p", "_l", "_r")


def seasonal_median(df: DataFrame, key: list[str], season: str, value: str, out: str = "fill") -> DataFrame:
    """The season's median of known values where the value is unknown."""
    m = df.groupBy(*key, season).agg(F.median(value).alias("_m"))
    return df.join(m, [*key, season]).withColumn(out, F.coalesce(F.col(value), F.col("_m"))).drop("_m")


def seasonal_residual_linear(df: DataFrame, key: list[str], at: str, season: str, value: str, out: str = "fill") -> DataFrame:
    """Season's median plus the linear interpolation of what known values differ from theirs."""
    m = df.groupBy(*key, season).agg(F.median(value).alias("_m"))
    d = df.join(m, [*key, season]).withColumn("_r", F.col(value) - F.col("_m"))
    d = linear(d, key, at, "_r", "_f")
    return d.withColumn(out, F.coalesce(F.col(value), F.col("_m") + F.col("_f"))).drop("_m", "_r", "_f")


def _filtered(x: np.ndarray, q: float, r: float, start: float) -> np.ndarray:
    """Level of a random walk of step variance q seen with variance r, from the past alone.

    The variances don't depend on the values, so the weight of each is found first (it
    settles after a few readings, and starts anew behind each gap) and the levels follow.
    """
    seen = np.isfinite(x)
    at = np.flatnonzero(seen)
    weight, spread, before = np.empty(len(at)), 100 * r, -1
    for k, i in enumerate(at.tolist()):
        prior = spread + (i - before) * q
        weight[k], spread, before = prior / (prior + r), prior * r / (prior + r), i
    levels = np.empty(len(at) + 1)
    levels[0] = start
    for k, (w, z) in enumerate(zip(weight.tolist(), x[at].tolist())):
        levels[k + 1] = (1 - w) * levels[k] + w * z
    return levels[np.cumsum(seen)]


def kalman_level(x: np.ndarray) -> np.ndarray:
    """Mean of a forward and a backward local-level filter over values with NaN gaps."""
    known = x[np.isfinite(x)]
    if not len(known):
        return x
    spread = float(np.var(np.diff(known))) if len(known) > 1 else 0.0
    q, r, start = max(0.05 * spread, 1e-8), max(0.5 * spread, 1e-8), float(np.median(known))
    return (_filtered(x, q, r, start) + _filtered(x[::-1], q, r, start)[::-1]) / 2


def local_level_kalman(df: DataFrame, key: list[str], at: str, value: str, out: str = "fill") -> DataFrame:
    """Kalman fill per key; a key is one bounded segment (see sequences.longest_segment), not a whole record."""
    cols = [*key, at, value]
    types = dict(df.dtypes)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(at)
        x = pdf[value].to_numpy(float)
        pdf[out] = np.where(np.isfinite(x), x, kalman_level(x))
        return pdf

    schema = ", ".join(f"`{c}` {types[c]}" for c in cols) + f", `{out}` double"
    return df.select(*cols).groupBy(*key).applyInPandas(run, schema)


def dense_hours(df: DataFrame, key: str, at: str) -> DataFrame:
    """Every step between a key's first and last; steps without a row have nulls."""
    span = df.groupBy(key).agg(F.min(at).alias("lo"), F.max(at).alias("hi"))
    grid = span.select(key, F.explode(F.sequence("lo", "hi")).alias(at))
    return grid.join(df, [key, at], "left")


def one_hour_fill(df: DataFrame, key: str, at: str, value: str) -> DataFrame:
    """A single missing step between two known ones takes their mean; ``filled`` marks it.

    Works from the known rows alone: a missing single step shows as a step of two, so no
    dense grid is built.
    """
    known = df.where(F.col(value).isNotNull()).select(key, at, value)
    before = previous(known, key, F.floor(F.col(at) / 4096).cast("long"), [at], [at, value], "_b")
    holes = before.select(key, at, value, F.col(f"_b.{at}").alias("_p"), F.col(f"_b.{value}").alias("_v")).where(F.col(at) - F.col("_p") == 2)
    filled = holes.select(key, (F.col(at) - 1).alias(at), ((F.col(value) + F.col("_v")) / 2).alias(value), F.lit(True).alias("filled"))
    return known.withColumn("filled", F.lit(False)).unionByName(filled)


def gap_metrics(df: DataFrame, key: list[str], truth: str, fill: str) -> DataFrame:
    """n, mae, rmse, bias, largest error, correlation (of three points or more that vary) and shift of the mean."""
    e = F.col(fill) - F.col(truth)
    return df.groupBy(*key).agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(e).alias("bias"),
        F.max(F.abs(e)).alias("max_abs"),
        F.when(F.count(F.lit(1)) >= 3, F.try_divide(F.covar_pop(truth, fill), F.stddev_pop(truth) * F.stddev_pop(fill))).alias("corr"),
        (F.avg(fill) - F.avg(truth)).alias("mean_shift"))
