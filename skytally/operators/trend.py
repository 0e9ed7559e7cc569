"""Robust trends of monthly series: pairwise slopes, seasonal variants, decomposition, intervals."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skytally.functions.columns import decimal_year

Z95 = 1.959963984540054


def pairs(df: DataFrame, key: list[str], mo: str, value: str, same_month: bool) -> DataFrame:
    """Later minus earlier for every pair of a key, with dx in years; ``same_month`` keeps pairs of one calendar month.

    A theta self-join on monthly series, whose length is bounded by the years observed. The
    same-month form meets on (key, month), a twelfth of the pairs.
    """
    a = df.select(*key, F.col(mo).alias("m0"), F.col(value).alias("y0"), (F.col(mo) % 12).alias("cm"))
    b = df.select(*key, F.col(mo).alias("m1"), F.col(value).alias("y1"), (F.col(mo) % 12).alias("cm"))
    joined = a.join(b, [*key, "cm"]) if same_month else a.drop("cm").join(b.drop("cm"), key)
    return (joined.where(F.col("m0") < F.col("m1"))
            .select(*key, (F.col("y1") - F.col("y0")).alias("dy"), ((F.col("m1") - F.col("m0")) / F.lit(12.0)).alias("dx")))


def sen_slope(df: DataFrame, key: list[str], mo: str, value: str, same_month: bool = False) -> DataFrame:
    """Median pairwise slope per year."""
    return pairs(df, key, mo, value, same_month).groupBy(*key).agg(F.median(F.col("dy") / F.col("dx")).alias("slope"), F.count(F.lit(1)).alias("n_pairs"))


def sen_by_key(df: DataFrame, key: str, at: str, value: str, per_year: float) -> DataFrame:
    """(key, n_pairs, slope): median slope per year over all pairs of a key's daily values.

    A key has at most one row a day, a few thousand in all, so its pairs are formed inside
    its task, a row at a time; no pair is shuffled.
    """
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(at)
        x, y = pdf[at].to_numpy(float), pdf[value].to_numpy(float)
        slopes = [(y[i + 1:] - y[i]) / ((x[i + 1:] - x[i]) / per_year) for i in range(len(x) - 1)]
        n = len(x) * (len(x) - 1) // 2
        return pd.DataFrame({key: pdf[key].iloc[:1], "n_pairs": [n], "slope": [float(np.median(np.concatenate(slopes))) if n else None]})

    return df.select(key, at, value).groupBy(key).applyInPandas(run, f"`{key}` {dict(df.dtypes)[key]}, n_pairs long, slope double")


def sen_interval(df: DataFrame, key: list[str], mo: str, value: str) -> DataFrame:
    """Sen slope with its 95 % rank bounds. Slopes of one key number n(n-1)/2 of its months; ranks come from a window over them."""
    p = pairs(df, key, mo, value, False).withColumn("s", F.col("dy") / F.col("dx"))
    n = df.groupBy(*key).agg(F.count(F.lit(1)).cast("double").alias("n"))
    ties = (df.groupBy(*key, value).agg(F.count(F.lit(1)).cast("double").alias("t")).groupBy(*key)
            .agg(F.sum(F.col("t") * (F.col("t") - 1) * (2 * F.col("t") + 5)).alias("ties")))
    w = Window.partitionBy(*key)
    ranked = p.withColumns({"r": F.row_number().over(w.orderBy("s")) - 1, "pairs": F.count(F.lit(1)).over(w)}).join(n, key).join(ties, key)
    sigma = F.sqrt((F.col("n") * (F.col("n") - 1) * (2 * F.col("n") + 5) - F.col("ties")) / 18)
    low = F.greatest(F.rint((F.col("pairs") - Z95 * sigma) / 2) - 1, F.lit(0.0))
    high = F.least(F.rint((F.col("pairs") + Z95 * sigma) / 2), F.col("pairs") - F.lit(1.0))
    return ranked.withColumns({"lo": low, "hi": high}).groupBy(*key).agg(
        F.median("s").alias("slope"), F.max(F.when(F.col("r") == F.col("lo"), F.col("s"))).alias("low"), F.max(F.when(F.col("r") == F.col("hi"), F.col("s"))).alias("high"))


def two_sided_p(z: str) -> Column:
    """Two-sided normal p of a z column; null stays null."""

    @F.pandas_udf("double")
    def p(x: pd.Series) -> pd.Series:
        return x.map(lambda v: math.erfc(abs(v) / math.sqrt(2)) if v == v else None)

    return p(z)


def seasonal_kendall(df: DataFrame, key: list[str], mo: str, value: str, least: int = 10) -> DataFrame:
    """Sum of signs over same-month pairs, variance pairs/3, continuity-corrected z; null below ``least`` pairs."""
    s = pairs(df, key, mo, value, True).groupBy(*key).agg(F.sum(F.signum("dy")).alias("s"), F.count(F.lit(1)).alias("n_pairs"))
    z = F.when(F.col("s") == 0, 0.0).otherwise((F.col("s") - F.signum("s")) / F.sqrt(F.col("n_pairs") / F.lit(3.0)))
    return s.withColumn("z", F.when(F.col("n_pairs") >= least, z))


def ols_slope(df: DataFrame, key: list[str], mo: str, value: str) -> DataFrame:
    x = decimal_year(F.col(mo))
    return df.groupBy(*key).agg(F.regr_slope(F.col(value), x).alias("ols"), F.corr(F.col(value), x).alias("r"), F.count(F.lit(1)).alias("n"))


def decompose(df: DataFrame, key: list[str], mo: str, value: str) -> DataFrame:
    """value = fitted + seasonal + residual, with the seasonal Sen slope from the first month.

    seasonal is the calendar month's median of the detrended values, less its mean over the
    observations; fitted is that mean plus slope times elapsed years.
    """
    slope = sen_slope(df, key, mo, value, True).select(*key, "slope")
    first = df.groupBy(*key).agg(F.min(mo).alias("m0"))
    d = df.select(*key, mo, value).join(slope, key).join(first, key)
    d = d.withColumn("rise", F.col("slope") * ((F.col(mo) - F.col("m0")) / F.lit(12.0))).withColumn("flat", F.col(value) - F.col("rise"))
    d = d.withColumn("cm", F.col(mo) % 12)
    month = d.groupBy(*key, "cm").agg(F.median("flat").alias("mm"))
    d = d.join(month, [*key, "cm"])
    centre = d.groupBy(*key).agg(F.avg("mm").alias("centre"))
    d = d.join(centre, key)
    fitted, seasonal = F.col("centre") + F.col("rise"), F.col("mm") - F.col("centre")
    return d.select(*key, mo, value, fitted.alias("fitted"), seasonal.alias("seasonal"), (F.col(value) - fitted - seasonal).alias("residual"))


def climatology(df: DataFrame, key: list[str], mo: str, value: str) -> DataFrame:
    """Mean of each calendar month (0 to 11)."""
    return df.groupBy(*key, (F.col(mo) % 12).alias("cm")).agg(F.avg(value).alias("clim"))


def amplitude(df: DataFrame, key: list[str], mo: str, value: str, least: int = 8) -> DataFrame:
    """Highest less lowest month of the climatology; null with fewer than ``least`` months. First month on ties."""
    c = climatology(df, key, mo, value)
    return c.groupBy(*key).agg(
        F.when(F.count(F.lit(1)) >= least, F.max("clim") - F.min("clim")).alias("amplitude"),
        F.min_by("cm", F.struct(-F.col("clim"), F.col("cm"))).alias("max_month"), F.min_by("cm", F.struct(F.col("clim"), F.col("cm"))).alias("min_month"))


def percentile_interval(slopes: DataFrame, key: list[str], value: str, estimate: Column) -> DataFrame:
    """Percentile, reflected and normal intervals of replicates around an estimate."""
    g = slopes.groupBy(*key).agg(F.percentile(value, F.array(F.lit(0.025), F.lit(0.975))).alias("q"), F.stddev(value).alias("sd"), F.max(estimate).alias("estimate"))
    lo, hi, e = F.col("q")[0], F.col("q")[1], F.col("estimate")
    return g.select(*key, "estimate", lo.alias("low"), hi.alias("high"), (2 * e - hi).alias("basic_low"), (2 * e - lo).alias("basic_high"),
                    (e - Z95 * F.col("sd")).alias("normal_low"), (e + Z95 * F.col("sd")).alias("normal_high"))
