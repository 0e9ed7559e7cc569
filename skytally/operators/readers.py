"""Body lines to UTC readings: layout, clock, sentinel, unit and quality flag in one operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skytally.functions.columns import lenient_factor, qc_decision, strict_factor, without_sentinel
from skytally.operators.rawlines import load_lines
from skytally.operators.skew import join_dimension

#: The period that the lenient reader keeps.
FIRST, STOP = "2015-01-01 00:00:00", "2025-01-01 00:00:00"
#: Fixed value: the lenient reader takes values at or below this as missing.
MISSING = -999.0


def _with_layout(raw: DataFrame, layout: DataFrame) -> DataFrame:
    dim = layout.where("record_id is not null").groupBy("record_id").agg(
        F.max("lst_to_utc_hours").alias("offset"), F.max("unit").alias("given_unit"), F.max("species").alias("species"))
    d = join_dimension(load_lines(raw, layout), dim, ["record_id"])
    utc = F.timestamp_micros(F.unix_micros(F.col("local_time").cast("timestamp")) + F.round(F.col("offset") * 3600).cast("long") * 1_000_000)
    return d.withColumn("utc", utc)


def parsed_rows(raw: DataFrame, layout: DataFrame, strict: bool = False) -> DataFrame:
    """Every body line as a reading, or with the problem that keeps it from being one.

    UTC = local time + the layout's offset; sentinels become null; values are converted to
    the gas's common unit, and an unknown unit is a problem; quality comes from QCflag,
    while qc_original is the contributor's own ORG_QCflag. Blank and # lines are left out.

    Defined cases: a line that can't be loaded or has no clock or offset has a problem and
    nulls, or raises with ``strict``; a field that the layout lacks is null; repeated lines
    are all kept; other columns of the inputs are ignored.
    """
    d = _with_layout(raw, layout).where("loaded is not null")
    original = without_sentinel(F.col("value"))
    factor = strict_factor(F.col("given_unit"), F.col("species"), fail=False)
    problem = F.coalesce("reason", F.when(F.col("utc").isNull(), "no instant"), F.when(original.isNotNull() & factor.isNull(), "unknown unit"))
    if strict:
        problem = F.when(problem.isNotNull(), F.raise_error(F.concat(F.lit("line "), F.col("line_no").cast("string"), F.lit(" of "), F.coalesce("record_id", F.lit("?")), F.lit(": "), problem)))
    qc = qc_decision(F.element_at("fields", "QCflag"))
    d = d.withColumns({"problem": problem.cast("string"), "qc": qc, "original_value": original})
    ok = F.col("problem").isNull()
    only = lambda c, name: F.when(ok, c).alias(name)
    return d.select(
        "raw_id", "record_id", "line_no", "problem", only(F.col("local_time"), "timestamp_source"), only(F.col("utc"), "timestamp_utc"),
        only(F.col("original_value"), "original_value"), only(F.col("original_value") * factor, "value"), only(F.when(F.upper("species") == "CO2", "ppm").otherwise("ppb"), "unit"),
        only(without_sentinel(F.col("value_wmo_scale")), "value_wmo_scale"), only(without_sentinel(F.col("value_sd")), "uncertainty"),
        only(F.element_at("fields", "ORG_QCflag"), "qc_original"), only(F.col("qc.standard"), "qc_standard"), only(F.col("qc.retain"), "qc_valid"),
        *[only(without_sentinel(F.col(a)), b) for a, b in (("latitude", "latitude"), ("longitude", "longitude"), ("elevation", "elevation_m"), ("intake_height", "intake_height_m"))])


def lenient_series(raw: DataFrame, layout: DataFrame) -> DataFrame:
    """(record_id, time, value, qc, valid) of the lines that can be read, inside FIRST to STOP, one row per instant.

    Values at or below MISSING are null; units are converted leniently; a reading is valid if
    its QCflag is 1 or 2 and it has a value. Of several lines of an instant the first in file
    order (line_no, then raw_id) stays. Lines that can't be read are skipped; a missing
    offset counts as 0.
    """
    d = _with_layout(raw, layout).where("loaded and local_time is not null")
    time = F.timestamp_micros(F.unix_micros(F.col("local_time").cast("timestamp")) + F.coalesce(F.round(F.col("offset") * 3600).cast("long"), F.lit(0)) * 1_000_000)
    value = F.when(F.col("value") > MISSING, F.col("value") * lenient_factor(F.lower("given_unit"), F.upper("species")))
    qc = F.coalesce(F.element_at("fields", "QCflag"), F.lit(""))
    d = d.select("raw_id", "record_id", "line_no", time.alias("time"), value.alias("value"), qc.alias("qc"))
    d = d.where((F.col("time") >= F.lit(FIRST).cast("timestamp")) & (F.col("time") < F.lit(STOP).cast("timestamp")))
    first = Window.partitionBy("record_id", "time").orderBy("line_no", "raw_id")
    d = d.withColumn("rn", F.row_number().over(first)).where("rn = 1")
    return d.select("record_id", "time", "value", "qc", (F.col("qc").isin("1", "2") & F.col("value").isNotNull()).alias("valid"))
