"""Queries of the core problems 1, 2, 3, 5 and 6 over their whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from skytally.operators import grid, rawlines, spikes, timestamps, units
from skytally.session import prepare
from skytally.sources.tables import table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.empty_hours(table(prepare(spark), sf_dir, "obs_parsed"))


def p1_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    g = grid.regular_grid(table(prepare(spark), sf_dir, "obs_parsed"))
    return g.withColumn("value", F.round("value", 5))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    spark = prepare(spark)
    return units.wrong_values(table(spark, sf_dir, "obs_incoming"), table(spark, sf_dir, "text_layout"))


def p2_converted(spark: SparkSession, sf_dir: str) -> DataFrame:
    spark = prepare(spark)
    return units.convert_units(table(spark, sf_dir, "obs_incoming"), table(spark, sf_dir, "text_layout"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    spark = prepare(spark)
    return timestamps.wrong_times(table(spark, sf_dir, "obs_incoming"), table(spark, sf_dir, "text_layout"))


def p3_instants(spark: SparkSession, sf_dir: str) -> DataFrame:
    spark = prepare(spark)
    return timestamps.normalise_times(table(spark, sf_dir, "obs_incoming"), table(spark, sf_dir, "text_layout"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    spark = prepare(spark)
    return rawlines.rejected_lines(table(spark, sf_dir, "raw_rows"), table(spark, sf_dir, "text_layout"))


def p5_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    spark = prepare(spark)
    lines = rawlines.load_lines(table(spark, sf_dir, "raw_rows"), table(spark, sf_dir, "text_layout"), with_fields=False)
    return lines


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spikes.implausible_rows(table(prepare(spark), sf_dir, "obs_parsed"))


def p6_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spikes.flag_implausible(table(prepare(spark), sf_dir, "obs_parsed"))


QUERIES = {f.__name__: f for f in (p1_found, p1_grid, p2_found, p2_converted, p3_found, p3_instants,
                                   p5_found, p5_lines, p6_found, p6_flags)}

_GOOD = """good as (
  select record_id, epoch_us(timestamp_utc) us, value, received_at, row_id from obs_parsed
  where qc_valid and value is not null and not isnan(value) and timestamp_utc is not null and record_id is not null)"""

SQL = {
    "p1_found": f"""with {_GOOD}, present as (select distinct record_id, us // 3600000000 h from good),
span as (select record_id, min(h) lo, max(h) hi from present group by 1),
hours as (select record_id, unnest(range(lo, hi + 1)) h from span)
select record_id, h * 3600 as hour_epoch from hours anti join present using (record_id, h)""",
    "p1_grid": f"""with {_GOOD},
latest as (select record_id, us, arg_max(value, (received_at, row_id)) v from good group by 1, 2),
cell as (select record_id, us // 3600000000 h, count(*) n, avg(v) mean, min(us) a_us, arg_min(v, us) a_v, max(us) b_us, arg_max(v, us) b_v
  from latest group by 1, 2),
span as (select record_id, min(h) lo, max(h) hi from cell group by 1),
hours as (select record_id, unnest(range(lo, hi + 1)) h from span),
m as (select record_id, h, n, mean,
  last_value(b_us ignore nulls) over p t0, last_value(b_v ignore nulls) over p v0,
  first_value(a_us ignore nulls) over f t1, first_value(a_v ignore nulls) over f v1
  from hours left join cell using (record_id, h)
  window p as (partition by record_id order by h rows between unbounded preceding and 1 preceding),
         f as (partition by record_id order by h rows between 1 following and unbounded following))
select record_id, h * 3600 as hour_epoch, coalesce(n, 0) as n_readings,
  round(case when n is not null then mean when t1 - t0 <= 21600000000
    then v0 + (v1 - v0) * ((h * 3600000000 + 1800000000 - t0) / (t1 - t0)::double) end, 5) as value,
  case when n is not null then 'observed' when t1 - t0 <= 21600000000 then 'filled' else 'missing' end as status,
  t0 // 1000000 as previous_epoch, t1 // 1000000 as next_epoch
from m""",
}

# The alternation of timestamps.py for an engine without look-ahead; zones through its own calendar, where the first of two instants counts
_TIMES = timestamps.PATTERN.replace("(?<", "(?P<").replace("(?![A-Za-z])", r"\b")
_ZONES = ", ".join(f"'{z}'" for z in timestamps.zone_names())
_SHORT = ", ".join(f"'{k}': {v}" for k, v in timestamps.ABBREVIATIONS.items())
_MONTHS = ", ".join(f"'{m}'" for m in timestamps.MONTHS)
_TEXTS = f"""r as (select i.row_id, i.record_id, i.timestamp_source, i.timestamp_utc as given, y.lst_to_utc_hours as off, y.metadata['dataset_date_order'] as ord, regexp_extract(i.timestamp_source, '{_TIMES}', [{", ".join(f"'{g}'" for g in timestamps.GROUPS)}]) as g
  from obs_incoming i left join text_layout y using (record_id)),
n as (select row_id, record_id, timestamp_source, given, off, nullif(g.z, '') as z, lower(g.ap) as ap, g.oy <> '' as yd, {", ".join(f"try_cast(nullif(g.{c}, '') as bigint) as {c}" for c in timestamps.GROUPS if c not in ("nmo", "f", "ap", "z"))},
  list_position([{_MONTHS}], lower(g.nmo[1:3])) as nmo, coalesce(try_cast(rpad(g.f[1:6], 6, '0') as bigint), 0) as us, upper(ord) = 'DMY' as dmy from r),
e as (select *, coalesce(cy, iy, oy, sy, ny) as yy, coalesce(cmo, imo, case when yd then 1 end, case when dmy then sb when not dmy then sa end, nmo) as mm, coalesce(cd, id, od, case when dmy then sa when not dmy then sb end, nd) as dd,
  coalesce(cmi, mi) as mn, coalesce(s, 0) as ss, case when coalesce(ap, '') = '' then coalesce(ch, h) when h between 1 and 12 then h % 12 + case when ap = 'p' then 12 else 0 end end as hh from n),
o as (select *, yy between 1 and 9999 and mm between 1 and 12 and dd >= 1 and mn < 60 and ss < 60 and (hh < 24 or (hh = 24 and mn = 0 and ss = 0 and us = 0)) as sound from e),
d as (select *, case when sound then case when dd <= case when yd then dayofyear(make_date(yy, 12, 31)) else day(last_day(make_date(yy, mm, 1))) end
  then epoch_us(make_date(yy, mm, 1)) // 1000000 + (dd - 1) * 86400 + hh * 3600 + mn * 60 + ss end end as wall from o),
t as (select *, case when z in ({_ZONES}) and wall is not null then make_timestamp(wall * 1000000) end as local from d),
x as (select *, epoch_us(timezone(z, local)) as late, epoch_us(timezone(z, local - interval 1 hour)) + 3600000000 as early from t where local is not null),
v as (select row_id, case when early < late and timezone(z, make_timestamptz(early)) = local then early else late end as by_region from x),
q as (select t.*, coalesce(ms * 1000, sec * 1000000, us + case when z is null then (wall + round(off * 3600)::bigint) * 1000000
  when regexp_matches(z, '^[+-]') then (wall - (case when z[1] = '-' then -1 else 1 end) * (z[2:3]::int * 3600 + z[-2:]::int * 60)) * 1000000
  when map_contains(map {{{_SHORT}}}, lower(z)) then (wall - map {{{_SHORT}}}[lower(z)]) * 1000000
  else by_region end) as instant from t left join v using (row_id))"""
SQL["p3_found"] = f"with {_TEXTS} select row_id from q where abs(epoch_us(given) - instant) > 1000000"
SQL["p3_instants"] = f"with {_TEXTS} select row_id, record_id, timestamp_source, timezone('UTC', given) as given, make_timestamp(instant) as instant from q"

_B = "[ \t\r]*"
_PART = f'{_B}(?:"(?:[^"]|"")*"{_B}|[^",]*)'
_FIELD = "list_extract(f, list_position(cols, '{0}'))"
_NUMBER = r"[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?"


def _clock_sql(part: str, low: int, high: int, absent: int) -> str:
    x = _FIELD.format(part)
    return f"case when not list_contains(cols, '{part}') then {absent} when regexp_full_match({x}, '[0-9]{{1,9}}') and {x}::int between {low} and {high} then {x}::int end as {part}"


_LINES = f"""l as (select r.raw_id, r.record_id, r.line_no, replace(coalesce(r.raw_line, ''), chr(10), ' ') as t, y.columns as cols, coalesce(lower(y.metadata['dataset_delimiter']) = 'comma', false) as is_c
  from raw_rows r left join text_layout y using (record_id)),
f as (select *, regexp_matches(t, '^[ \t\r]*(#|$)') as skip, is_c and not regexp_full_match(t, '{_PART}(?:,{_PART})*') as broken, case
  when is_c then [case when x like '"%"' and length(x) > 1 then replace(x[2:-2], '""', '"') else x end for x in [trim(z, ' ' || chr(9) || chr(13)) for z in regexp_extract_all(t, '(?:^|,)({_PART})', 1)]]
  else list_filter(regexp_split_to_array(t, '[ \t\r]+'), lambda z: z <> '') end as f from l),
c as (select *, {", ".join(_clock_sql(p, *r) for p, r in zip(rawlines.CLOCK, rawlines.CLOCK_RANGE))},
  {", ".join(f"case when regexp_full_match({_FIELD.format(c)}, '{_NUMBER}') and isfinite(try_cast({_FIELD.format(c)} as double)) then {_FIELD.format(c)}::double end as {c}" for c in rawlines.NUMERIC)} from f),
j as (select *, case when skip then null when cols is null then 'no layout' when broken then 'broken quoting' when len(f) <> len(cols) then 'field count'
  when st_year is null or st_month is null or st_day is null or st_hour is null or st_minute is null or st_second is null then 'clock'
  when st_day > day(last_day(make_date(st_year, st_month, 1))) then 'clock'
  when {" or ".join(f"(list_contains(cols, '{c}') and {c} is null)" for c in rawlines.NUMERIC)} then 'number' end as reason from c)"""
SQL["p5_found"] = f"with {_LINES} select raw_id from j where not skip and reason is not null"
SQL["p5_lines"] = f"""with {_LINES}, k as (select *, not skip and reason is null as ok from j)
select raw_id, record_id, line_no, case when not skip then ok end as loaded, reason, case when ok and list_contains(cols, 'st_year') then make_timestamp(st_year, st_month, st_day, st_hour, st_minute, st_second::double) end as local_time,
  {", ".join(f"case when ok then {c} end as {c}" for c in rawlines.NUMERIC)} from k"""
