"""Four anomaly detectors on hourly series, and how their flags are judged."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skytally.operators.rolling import group_median, rolling_centre_and_scale

FLOOR = 1e-9
KS = (3.0, 4.0, 5.0)
METHODS = ("seasonal_mad", "rolling_seasonal_mad", "hampel_7day", "iqr_hour")


def hour_of_day(h: str = "h") -> Column:
    return F.pmod(F.col(h), F.lit(24))


def _seasonal_mad(df: DataFrame, key: str, at: str, value: str):
    d = df.select(key, at, value).withColumn("hod", hour_of_day(at))
    d = group_median(d, [key, "hod"], value, "m").withColumn("r", F.col(value) - F.col("m"))
    d = group_median(d, [key, "hod"], "r", "rm").withColumn("a", F.abs(F.col("r") - F.col("rm")))
    d = group_median(d, [key, "hod"], "a", "s")
    return d, lambda k: F.abs("r") > k * F.greatest(F.lit(1.4826) * F.col("s"), F.lit(FLOOR))


def _beyond_rolling(value: str):
    def flag(k: float) -> Column:
        far = F.abs(F.col(value) - F.col("centre")) > k * F.greatest(F.lit(1.4826) * F.col("scale"), F.lit(FLOOR))
        return F.coalesce(far, F.lit(False))
    return flag


def _rolling_seasonal_mad(df: DataFrame, key: str, at: str, value: str, half: int = 168, least: int = 72):
    d = group_median(df.select(key, at, value).withColumn("hod", hour_of_day(at)), [key, "hod"], value, "m")
    d = d.select(key, at, (F.col(value) - F.col("m")).alias(value))
    return rolling_centre_and_scale(d, key, at, value, half, least), _beyond_rolling(value)


def _hampel(df: DataFrame, key: str, at: str, value: str, half: int = 84, least: int = 48):
    return rolling_centre_and_scale(df, key, at, value, half, least), _beyond_rolling(value)


def _iqr_hour(df: DataFrame, key: str, at: str, value: str):
    d = df.select(key, at, value).withColumn("hod", hour_of_day(at))
    q = d.groupBy(key, "hod").agg(F.percentile(value, F.array(F.lit(0.25), F.lit(0.75))).alias("q"))
    lo, hi = F.col("q")[0], F.col("q")[1]
    wide = lambda k: k * 0.5 * (hi - lo) + FLOOR  # noqa: E731  # equal to the limit is inside, whatever the last bit of a quartile
    return d.join(q, [key, "hod"]), lambda k: (F.col(value) < lo - wide(k)) | (F.col(value) > hi + wide(k))


def seasonal_mad(df: DataFrame, key: str, at: str, value: str, k: float) -> DataFrame:
    """Residual from the median of the hour of day, beyond k MADs of that hour."""
    return flags(df, key, at, value, "seasonal_mad", k)


def rolling_seasonal_mad(df: DataFrame, key: str, at: str, value: str, k: float, half: int = 168, least: int = 72) -> DataFrame:
    """Residual from the hour's median, then a rolling centre and scale of those."""
    d, flag = _rolling_seasonal_mad(df, key, at, value, half, least)
    return d.select(key, at, value, flag(k).alias("flag"))


def hampel(df: DataFrame, key: str, at: str, value: str, k: float, half: int = 84, least: int = 48) -> DataFrame:
    d, flag = _hampel(df, key, at, value, half, least)
    return d.select(key, at, value, flag(k).alias("flag"))


def iqr_hour(df: DataFrame, key: str, at: str, value: str, k: float) -> DataFrame:
    """Outside the hour's quartiles by more than half k interquartile ranges."""
    return flags(df, key, at, value, "iqr_hour", k)


def _judged(df: DataFrame, key: str, at: str, value: str, method: str):
    found = {"seasonal_mad": _seasonal_mad, "rolling_seasonal_mad": _rolling_seasonal_mad, "hampel_7day": _hampel, "iqr_hour": _iqr_hour}
    if method not in found:
        raise ValueError(f"unknown detector {method}")
    return found[method](df, key, at, value)


def flags(df: DataFrame, key: str, at: str, value: str, method: str, k: float) -> DataFrame:
    """Dispatch by name; an unknown name raises."""
    d, flag = _judged(df, key, at, value, method)
    return d.select(key, at, value, flag(k).alias("flag"))


def flags_each(df: DataFrame, key: str, at: str, value: str, method: str, ks: tuple[float, ...]) -> DataFrame:
    """Flags of one detector at every k: a row's distance and scale are found once."""
    d, flag = _judged(df, key, at, value, method)
    return d.select(key, at, F.inline(F.array(*[F.struct(F.lit(k).alias("k"), flag(k).alias("flag")) for k in ks])))


def confusion(flag: Column, truth: Column) -> list[Column]:
    """tp, fp, fn, tn as aggregates."""
    n = lambda c: F.sum(c.cast("long"))
    return [n(flag & truth).alias("tp"), n(flag & ~truth).alias("fp"), n(~flag & truth).alias("fn"), n(~flag & ~truth).alias("tn")]


def rates(df: DataFrame) -> DataFrame:
    """prec (precision), recall, f1 and fpr from the four counts; 0 where undefined."""
    z = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    tp, fp, fn, tn = (F.col(c).cast("double") for c in ("tp", "fp", "fn", "tn"))
    df = df.withColumns({"prec": z(tp, tp + fp), "recall": z(tp, tp + fn), "fpr": z(fp, fp + tn)})
    return df.withColumn("f1", z(2 * F.col("prec") * F.col("recall"), F.col("prec") + F.col("recall")))
