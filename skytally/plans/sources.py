"""Queries of headers and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skytally.functions import columns as fx
from skytally.operators import readers
from skytally.plans.problems import _FIELD, _LINES
from skytally.session import prepare
from skytally.sources import text
from skytally.sources.tables import table
from skytally.streaming import folds


def a01_layouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Layouts written as header lines and parsed again."""
    d = text.parse_headers(text.header_lines(table(prepare(spark), sf_dir, "text_layout")))
    return d.select(F.col("file").alias("record_id"), "species", "unit", "lst_to_utc_hours", F.array_join("columns", " ").alias("column_list"), "problem")


def l01_stream_monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folds.run_to_table(folds.monthly_counts(folds.reading_stream(prepare(spark), sf_dir)))


def a02_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    spark = prepare(spark)
    d = readers.parsed_rows(table(spark, sf_dir, "raw_rows"), table(spark, sf_dir, "text_layout"))
    return d.withColumns({c: F.round(c, 6) for c in ("original_value", "value")})


def a04_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    spark = prepare(spark)
    return readers.lenient_series(table(spark, sf_dir, "raw_rows"), table(spark, sf_dir, "text_layout")).withColumn("value", F.round("value", 6))


QUERIES = {f.__name__: f for f in (a01_layouts, a02_rows, a04_series, l01_stream_monthly)}
_SENT = lambda c: f"case when {c} in (-999.999, -999999.999, -999.999999999) or {c} <= -999999 then null else {c} end"
_FACTORS = "case " + " ".join(f"when translate(lower(trim(y.unit)), 'µμ', 'uu') = '{u}' and upper(trim(y.species)) = '{g}' then {f!r}::double" for (u, g), f in fx.UNIT_FACTOR.items()) + " end"
_QC = f"trim(coalesce({_FIELD.format('QCflag')}, ''))"
_READ = f"""{_LINES}, r as (select j.*, y.unit as given_unit, y.species, y.lst_to_utc_hours as off, {_FACTORS} as factor, {_SENT("value")} as original_value,
  case when reason is null and list_contains(cols, 'st_year') then make_timestamp(st_year, st_month, st_day, st_hour, st_minute, st_second::double) end as at_local from j left join text_layout y using (record_id) where not skip)"""
SQL = {
    "a02_rows": f"""with {_READ}, p as (select *, at_local + to_seconds(round(off * 3600)::bigint) as utc from r),
q as (select *, coalesce(reason, case when utc is null then 'no instant' end, case when original_value is not null and factor is null then 'unknown unit' end) as problem from p)
select raw_id, record_id, line_no, problem, case when problem is null then at_local end as timestamp_source, case when problem is null then utc end as timestamp_utc,
  case when problem is null then round(original_value, 6) end as original_value, case when problem is null then round(original_value * factor, 6) end as value,
  case when problem is null then case when upper(species) = 'CO2' then 'ppm' else 'ppb' end end as unit, case when problem is null then {_SENT("value_wmo_scale")} end as value_wmo_scale,
  case when problem is null then {_SENT("value_sd")} end as uncertainty, case when problem is null then {_FIELD.format("ORG_QCflag")} end as qc_original,
  case when problem is null then case {_QC} when '1' then 'valid_background' when '2' then 'valid' when '3' then 'invalid' else 'unknown' end end as qc_standard,
  case when problem is null then {_QC} in ('1', '2') end as qc_valid, case when problem is null then {_SENT("latitude")} end as latitude, case when problem is null then {_SENT("longitude")} end as longitude,
  case when problem is null then {_SENT("elevation")} end as elevation_m, case when problem is null then {_SENT("intake_height")} end as intake_height_m from q""",
    "a04_series": f"""with {_READ}, p as (select raw_id, record_id, line_no, at_local + to_seconds(coalesce(round(off * 3600)::bigint, 0)) as time,
  case when value > -999 then value * case when contains(lower(given_unit), 'mol/mol') and not regexp_matches(lower(given_unit), '^[a-zµ]mol') then case when upper(species) = 'CO2' then 1e6 else 1e9 end
    when lower(given_unit) = 'ppm' and upper(species) = 'CH4' then 1e3 else 1.0 end end as value, coalesce({_FIELD.format("QCflag")}, '') as qc from r where reason is null and at_local is not null)
select record_id, time, round(value, 6) as value, qc, qc in ('1', '2') and value is not null as valid
from (select *, row_number() over (partition by record_id, time order by line_no, raw_id) as rn from p where time >= timestamp '2015-01-01' and time < timestamp '2025-01-01') where rn = 1""",
    "a01_layouts": """select record_id, upper(metadata['dataset_parameter']) as species, metadata['value_units'] as unit, metadata['dataset_lst2utc']::double as lst_to_utc_hours,
  array_to_string(columns, ' ') as column_list, null::varchar as problem from text_layout""",
    "l01_stream_monthly": """select record_id, year(timestamp_utc) * 12 + month(timestamp_utc) - 1 as mo, count(*) as n, min(value) as lowest, max(value) as highest
  from obs_parsed where qc_valid and value is not null and not isnan(value) and timestamp_utc is not null group by 1, 2""",
}
