"""Headers of observation files as lines of a DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skytally.functions.columns import normal_key

#: Fixed value: the header line after which the column list stands.
ORDER_LINE = "VARIABLE ORDER"


def parse_headers(lines: DataFrame, strict: bool = True) -> DataFrame:
    """(file, line_no, text) of header lines to one layout per file.

    "key : value" splits at the first blank-colon-blank, else (strict) at the first colon or
    equals sign; keys are folded by normal_key. The column list is the first line with text
    after the order line. Columns: file, metadata, columns, species, unit,
    lst_to_utc_hours, problem (null if the layout can be used). A repeated key keeps its
    first value; files without a usable header have a problem, not an error.
    """
    body = lines.where("file is not null and text is not null").withColumn("t", F.trim(F.regexp_replace("text", "^#+", "")))
    split = F.when(F.col("t").contains(" : "), F.array(F.substring_index("t", " : ", 1), F.expr("substring(t, length(substring_index(t, ' : ', 1)) + 4)")))
    if strict:
        other = F.regexp_extract("t", r"^([^:=]+)[:=]\s*(.*)$", 1)
        split = F.coalesce(split, F.when(other != "", F.array(other, F.regexp_extract("t", r"^[^:=]+[:=]\s*(.*)$", 1))))
    parsed = body.select("file", "line_no", "t", normal_key(split[0]).alias("key"), F.trim(split[1]).alias("value"))
    pairs = parsed.where("key <> ''").groupBy("file", "key").agg(F.min_by("value", "line_no").alias("value"))
    metadata = pairs.groupBy("file").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("key", "value")))).alias("metadata"))
    order = parsed.where(F.upper("t") == ORDER_LINE).groupBy("file").agg(F.min("line_no").alias("at"))
    listed = parsed.join(order, "file").where((F.col("line_no") > F.col("at")) & (F.col("t") != "")).groupBy("file").agg(F.min_by("t", "line_no").alias("list"))
    d = lines.where("file is not null").select("file").distinct().join(metadata, "file", "left").join(listed, "file", "left")
    species = F.upper(F.element_at("metadata", "dataset_parameter"))
    unit = F.element_at("metadata", "value_units")
    offset = F.coalesce(F.element_at("metadata", "dataset_lst2utc").try_cast("double"),
                        F.when(F.upper(F.element_at("metadata", "dataset_time_zone")) == "UTC", F.lit(0.0)))
    if not strict:
        offset = F.coalesce(offset, F.lit(0.0))
    d = d.select("file", "metadata", F.split("list", r"\s+").alias("columns"), species.alias("species"), unit.alias("unit"), offset.alias("lst_to_utc_hours"))
    problem = (F.when(F.col("columns").isNull(), "no column order").when(~F.coalesce(F.col("species").isin("CO2", "CH4"), F.lit(False)), "unknown species")
               .when(F.col("unit").isNull(), "no unit").when(F.col("lst_to_utc_hours").isNull(), "unverified offset"))
    return d.withColumn("problem", problem)


def header_lines(layouts: DataFrame) -> DataFrame:
    """The header lines that a layout would be read from: (file, line_no, text)."""
    keys = F.transform(F.map_entries("metadata"), lambda e: F.concat(F.lit("# "), e["key"], F.lit(" : "), e["value"]))
    text = F.concat(keys, F.array(F.lit("# " + ORDER_LINE), F.lit("#"), F.concat(F.lit("# "), F.array_join("columns", " "))))
    return layouts.where("metadata is not null and columns is not null").select(F.col("record_id").alias("file"), F.posexplode(text).alias("line_no", "text"))
