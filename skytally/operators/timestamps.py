"""Problem 3: timestamps of many formats, precisions and zones to one UTC instant."""

from __future__ import annotations

import zoneinfo

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skytally.operators.skew import join_dimension

#: Every format in one alternation (Java syntax). Order matters only between the digit strings.
PATTERN = (
    r"^\s*(?:(?<ms>\d{13})|(?<sec>\d{10})"
    r"|(?<cy>\d{4})(?<cmo>\d{2})(?<cd>\d{2})(?<ch>\d{2})(?<cmi>\d{2})"
    r"|(?:(?<iy>\d{4})-(?<imo>\d{1,2})-(?<id>\d{1,2})"
    r"|(?<oy>\d{4})-(?<od>\d{3})"
    r"|(?<sa>\d{1,2})/(?<sb>\d{1,2})/(?<sy>\d{4})"
    r"|(?<nd>\d{1,2})[ -](?<nmo>[A-Za-z]{3,9})\.?[ -](?<ny>\d{4}))"
    r"[T ]\s*(?<h>\d{1,2}):(?<mi>\d{2})(?::(?<s>\d{2})(?:[.,](?<f>\d{1,9}))?)?"
    r"\s*(?:(?<ap>[AaPp])[Mm](?![A-Za-z]))?"
    r"\s*(?<z>[A-Za-z][A-Za-z0-9_/+-]*|[+-]\d{2}:?\d{2})?)\s*$"
)
GROUPS = ("ms", "sec", "cy", "cmo", "cd", "ch", "cmi", "iy", "imo", "id", "oy", "od", "sa", "sb", "sy",
          "nd", "nmo", "ny", "h", "mi", "s", "f", "ap", "z")
SEP = "\u0001"

#: Month names by their first three letters.
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
#: Zone abbreviations and their offset from UTC in seconds.
ABBREVIATIONS = {
    "z": 0, "utc": 0, "gmt": 0, "wet": 0, "west": 3600, "bst": 3600, "cet": 3600, "cest": 7200,
    "eet": 7200, "eest": 10800, "msk": 10800, "jst": 32400, "kst": 32400, "sast": 7200,
    "acst": 34200, "acdt": 37800, "aest": 36000, "aedt": 39600, "awst": 28800, "nzst": 43200, "nzdt": 46800,
    "nst": -12600, "ndt": -9000, "ast": -14400, "adt": -10800, "est": -18000, "edt": -14400,
    "cst": -21600, "cdt": -18000, "mst": -25200, "mdt": -21600, "pst": -28800, "pdt": -25200,
    "akst": -32400, "akdt": -28800, "hst": -36000,
}


def days_from_civil(y: Column, m: Column, d: Column) -> Column:
    """Days since 1970-01-01 of a proleptic Gregorian date, in whole numbers only."""
    year = y - F.when(m <= 2, 1).otherwise(0)
    era = F.floor(year / 400)
    in_era = year - era * 400
    day = F.floor((153 * (m + F.when(m > 2, -3).otherwise(9)) + 2) / 5) + d - 1
    return era * 146097 + in_era * 365 + F.floor(in_era / 4) - F.floor(in_era / 100) + day - 719468


def month_length(y: Column, m: Column) -> Column:
    leap = ((y % 4 == 0) & (y % 100 != 0)) | (y % 400 == 0)
    return F.when(m == 2, F.when(leap, 29).otherwise(28)).when(m.isin(4, 6, 9, 11), 30).otherwise(31)


def zone_names() -> list[str]:
    """IANA names that both sides of Spark know; they alone reach the zone conversion. Abbreviations have their fixed offset instead."""
    odd = ("Factory", "localtime", "posixrules", "GMT+0", "GMT-0", "ROC", "EST", "MST", "HST")
    return sorted(n for n in zoneinfo.available_timezones() if n not in odd and not n.startswith(("posix/", "right/", "SystemV/")))


def with_components(df: DataFrame, text: str) -> DataFrame:
    """Run the alternation once per row and lay its named groups into the array ``_parts``.

    A text that doesn't match stays as it is and so gives an array of one; it has no parts.
    """
    template = SEP.join(f"${{{g}}}" for g in GROUPS)
    split = F.split(F.regexp_replace(F.translate(text, SEP, " "), PATTERN, template), SEP)
    return df.withColumn("_parts", split).withColumn("_parts", F.when(F.size("_parts") == len(GROUPS), F.col("_parts")))


def fixed(df: DataFrame, column: str, out: str) -> DataFrame:
    """Rename a column so that later filters read its value.

    The optimiser would copy the whole text of the expression into a filter on it; behind a
    generator it stays one value.
    """
    return df.select("*", F.inline(F.array(F.struct(F.col(column).alias(out)))))


def parse_instants(df: DataFrame, text: str, offset_hours: str, date_order: str, out: str = "instant_us") -> DataFrame:
    """Add ``out``, microseconds since 1970 UTC, or null where the text names no instant.

    ``text`` without a zone is local standard time: UTC = text + ``offset_hours`` hours.
    ``date_order`` (DMY or MDY) reads dates with slashes. 24:00 ends the day. A zone name
    or abbreviation means that zone's time; 10 or 13 digits count from 1970 in UTC, 12 are
    a written local date. At an hour that a zone's clock shows twice the first one counts.

    Defined cases: null, empty, very long or unknown text, an impossible date or clock
    time, an unknown zone, or a missing offset or date order where one is needed give null.
    """
    p = lambda g: F.get("_parts", F.lit(GROUPS.index(g)))
    # the pattern leaves digits or nothing; try_cast would throw and catch on every empty group
    n = lambda g: F.nullif(p(g), F.lit("")).cast("long")
    df = with_components(df, text)
    named = F.array_position(F.array(*[F.lit(m) for m in MONTHS]), F.lower(F.substring(p("nmo"), 1, 3)))
    dmy = F.upper(F.col(date_order)) == "DMY"
    y = F.coalesce(n("cy"), n("iy"), n("oy"), n("sy"), n("ny"))
    mo = F.coalesce(n("cmo"), n("imo"), F.when(n("oy").isNotNull(), F.lit(1)),
                    F.when(dmy, n("sb")).when(~dmy, n("sa")), named)
    d = F.coalesce(n("cd"), n("id"), n("od"), F.when(dmy, n("sa")).when(~dmy, n("sb")), n("nd"))
    df = df.withColumns({"_y": y, "_mo": mo, "_d": d, "_h": F.coalesce(n("ch"), n("h")), "_mi": F.coalesce(n("cmi"), n("mi")),
                         "_s": F.coalesce(n("s"), F.lit(0)), "_ap": F.coalesce(F.lower(p("ap")), F.lit("")),
                         "_f": F.coalesce(F.rpad(F.substring(p("f"), 1, 6), 6, "0").cast("long"), F.lit(0)),
                         "_z": F.nullif(p("z"), F.lit("")), "_yd": n("oy").isNotNull(),
                         "_clock": F.coalesce(n("ms") * 1000, n("sec") * 1_000_000)}).drop("_parts")
    hour = (F.when(F.col("_ap") == "", F.col("_h"))
            .when(F.col("_h").between(1, 12), F.col("_h") % 12 + F.when(F.col("_ap") == "p", 12).otherwise(0)))
    df = df.withColumns({"_hour": hour})
    year_days = F.when(F.col("_yd"), 337 + month_length(F.col("_y"), F.lit(2)))
    sound = (
        F.col("_y").between(1, 9999) & F.col("_mo").between(1, 12) & (F.col("_d") >= 1)
        & (F.col("_d") <= F.coalesce(year_days, month_length(F.col("_y"), F.col("_mo"))))
        & (F.col("_mi") < 60) & (F.col("_s") < 60)
        & ((F.col("_hour") < 24) | ((F.col("_hour") == 24) & (F.col("_mi") == 0) & (F.col("_s") == 0) & (F.col("_f") == 0))))
    wall_s = days_from_civil(F.col("_y"), F.col("_mo"), F.col("_d")) * 86400 + F.col("_hour") * 3600 + F.col("_mi") * 60 + F.col("_s")
    df = df.withColumns({"_wall": F.when(sound, wall_s)})
    z = F.col("_z")
    digits = F.translate(z, ":", "")
    signed = F.when(z.rlike(r"^[+-]\d"), (F.substring(digits, 2, 2).cast("long") * 3600 + F.substring(digits, 4, 2).cast("long") * 60)
                    * F.when(z.startswith("-"), -1).otherwise(1))
    short = F.element_at(F.create_map(*[F.lit(x) for kv in ABBREVIATIONS.items() for x in kv]), F.lower(z))
    df = df.withColumns({"_zone_s": F.coalesce(signed, short), "_region": F.when(z.isin(zone_names()), z)})
    by_region = F.unix_micros(F.to_utc_timestamp(F.timestamp_micros(F.col("_wall") * 1_000_000), F.coalesce("_region", F.lit("UTC"))))
    local = (F.col("_wall") + F.round(F.col(offset_hours) * 3600).cast("long")) * 1_000_000
    instant = F.coalesce("_clock", F.col("_f") + (
        F.when(z.isNull(), local).when(F.col("_zone_s").isNotNull(), (F.col("_wall") - F.col("_zone_s")) * 1_000_000)
        .when(F.col("_region").isNotNull(), by_region)))
    return fixed(df.withColumn("_instant", instant), "_instant", out).drop("_instant", "_y", "_mo", "_d", "_h", "_mi", "_s", "_f", "_ap", "_hour", "_wall", "_z", "_yd", "_clock", "_zone_s", "_region")


def normalise_times(incoming: DataFrame, layout: DataFrame) -> DataFrame:
    """obs_incoming with ``instant`` (timestamp, null if the text names none) and ``given`` (the loader's).

    Columns: row_id, record_id, timestamp_source, given, instant. Rows with a null record_id
    or without a layout keep their row; only text that needs the layout then gives null.
    Repeated rows are all kept. Other columns of the inputs are ignored.
    """
    dim = layout.where("record_id is not null").groupBy("record_id").agg(
        F.max("lst_to_utc_hours").alias("_offset"), F.max(F.element_at("metadata", "dataset_date_order")).alias("_order"))
    rows = incoming.select("row_id", "record_id", "timestamp_source", F.col("timestamp_utc").alias("given"))
    parsed = parse_instants(join_dimension(rows, dim, ["record_id"]), "timestamp_source", "_offset", "_order")
    return parsed.select("row_id", "record_id", "timestamp_source", "given", F.timestamp_micros("instant_us").alias("instant"))


def wrong_times(incoming: DataFrame, layout: DataFrame) -> DataFrame:
    """Rows whose given instant is more than a second off the text's."""
    off = F.abs(F.unix_micros("given") - F.unix_micros("instant"))
    return normalise_times(incoming, layout).where(off > 1_000_000).select("row_id")
