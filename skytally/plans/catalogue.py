"""Queries on single rows, the catalogue, cohorts and joins (families A, B, C, D, F)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skytally.functions import columns as fx
from skytally.operators import cohort, diff
from skytally.operators.sequences import farthest_points, head_rows, top_rows
from skytally.operators.skew import join_dimension
from skytally.plans.domain import monthly, monthly_sql
from skytally.session import prepare
from skytally.sources.tables import table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f
    return add


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return table(prepare(spark), sf_dir, name)


@query("""select row_id, nullif(trim(coalesce(qc_original, '')), '') as original,
  case trim(coalesce(qc_original, '')) when '1' then 'valid_background' when '2' then 'valid' when '3' then 'invalid' else 'unknown' end as standard,
  trim(coalesce(qc_original, '')) in ('1', '2') as retain, trim(coalesce(qc_original, '')) not in ('1', '2', '3') as needs_human from obs_incoming""")
def b01_qc_map(spark, sf_dir):
    return _t(spark, sf_dir, "obs_incoming").select("row_id", F.inline(F.array(fx.qc_decision(F.col("qc_original")))))


_FACTOR = "case " + " ".join(f"when lower(trim(l.unit)) = '{u}' and l.species = '{g}' then {f!r}::double" for (u, g), f in fx.UNIT_FACTOR.items()) + " end"


@query(f"""select row_id, round(o.original_value * ({_FACTOR}), 6) as converted from obs_parsed o join text_layout l using (record_id)""")
def b02_units(spark, sf_dir):
    lay = _t(spark, sf_dir, "text_layout").select("record_id", F.col("unit").alias("lu"), "species")
    d = join_dimension(_t(spark, sf_dir, "obs_parsed").select("row_id", "record_id", "original_value"), lay, ["record_id"], "inner")
    return d.select("row_id", F.round(F.col("original_value") * fx.strict_factor(F.col("lu"), F.col("species")), 6).alias("converted"))


@query("""select record_id, unit, species, case when contains(unit, 'mol/mol') and not regexp_matches(unit, '^[a-zµ]mol') then case when species = 'CO2' then 1e6 else 1e9 end
  when unit = 'ppm' and species = 'CH4' then 1e3 else 1.0 end as factor from text_layout""")
def b03_lenient_factor(spark, sf_dir):
    return _t(spark, sf_dir, "text_layout").select("record_id", "unit", "species", fx.lenient_factor(F.col("unit"), F.col("species")).alias("factor"))


@query("""select record_id, count(*) as n, count(case when original_value in (-999.999, -999999.999, -999.999999999) or original_value <= -999999 or isnan(original_value) then null else original_value end) as n_value
from obs_incoming group by 1""")
def b04_sentinels(spark, sf_dir):
    return _t(spark, sf_dir, "obs_incoming").groupBy("record_id").agg(F.count(F.lit(1)).alias("n"), F.count(fx.without_sentinel(F.col("original_value"))).alias("n_value"))


@query("""select record_id, count(*) as n from obs_parsed where timestamp_utc >= timestamptz '2016-01-01 00:00:00+00' and timestamp_utc < timestamptz '2022-01-01 00:00:00+00' group by 1""")
def b05_period(spark, sf_dir):
    d = _t(spark, sf_dir, "obs_parsed")
    return d.where((F.col("timestamp_utc") >= F.lit("2016-01-01 00:00:00").cast("timestamp")) & (F.col("timestamp_utc") < F.lit("2022-01-01 00:00:00").cast("timestamp"))).groupBy("record_id").agg(F.count(F.lit(1)).alias("n"))


_ROW = "row_number() over (partition by record_id order by station_name, country nulls first, elevation nulls first)"
_CAND = f"""c as (select * from (select *, {_ROW} rn from candidate) where rn = 1)"""


def _candidates(spark, sf_dir):
    """One row per record; repeated rows and dirty names are folded by a total order."""
    d = _t(spark, sf_dir, "candidate")
    w = Window.partitionBy("record_id").orderBy("station_name", F.asc_nulls_first("country"), F.asc_nulls_first("elevation"))
    return d.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")


_OPEN = "hourly and accessible and lower(trim(coalesce(station_status, ''))) = 'operational' and (wmo_category = 'GAW Global' or regexp_matches(wmo_region, 'Africa|South America'))"


@query(f"with {_CAND} select gas, wmo_region, record_id from c where {_OPEN}")
def b06_select(spark, sf_dir):
    d = _candidates(spark, sf_dir)
    chosen = (F.col("hourly") & F.col("accessible") & (F.lower(F.trim(F.coalesce("station_status", F.lit("")))) == "operational")
              & ((F.col("wmo_category") == "GAW Global") | F.col("wmo_region").rlike("Africa|South America")))
    return d.where(chosen).select("gas", "wmo_region", "record_id").orderBy("gas", "wmo_region", "record_id")


@query(f"""with {_CAND} select record_id, case when {_OPEN} then 'SELECTED' when not hourly then 'NOT_HOURLY' when not accessible then 'LOCKED'
  when lower(trim(coalesce(station_status, ''))) <> 'operational' then 'CLOSED' else 'OUTSIDE_RULE' end as screening from c""")
def b07_screen(spark, sf_dir):
    d = _candidates(spark, sf_dir)
    operational = F.lower(F.trim(F.coalesce("station_status", F.lit("")))) == "operational"
    rule = (F.col("wmo_category") == "GAW Global") | F.col("wmo_region").rlike("Africa|South America")
    return d.select("record_id", F.when(F.col("hourly") & F.col("accessible") & operational & rule, "SELECTED").when(~F.col("hourly"), "NOT_HOURLY")
                    .when(~F.col("accessible"), "LOCKED").when(~operational, "CLOSED").otherwise("OUTSIDE_RULE").alias("screening"))


_LAST = "last as (select record_id, count(*) n, max(timestamp_utc) filter (qc_valid) as last_good from obs_parsed group by 1)"


@query(f"""with {_CAND}, {_LAST} select c.record_id, case when hourly then 'hourly' when daily then 'daily' when monthly then 'monthly' when event then 'event' else 'none' end as resolution,
  case when not hourly then 'SCREENED_OUT' when not accessible then 'LOCKED' when n is null then 'NOT_ACQUIRED' when last_good is null then 'NO_GOOD_READING'
    when last_good < timestamptz '2018-01-01 00:00:00+00' then 'INSUFFICIENT_TARGET_PERIOD' when n >= 500 then 'CORE' else 'EXTENDED' end as status
from c left join last using (record_id)""")
def b09_ledger(spark, sf_dir):
    obs = _t(spark, sf_dir, "obs_parsed").groupBy("record_id").agg(F.count(F.lit(1)).alias("n"), F.max(F.when(F.col("qc_valid"), F.col("timestamp_utc"))).alias("last_good"))
    d = _candidates(spark, sf_dir).join(obs, "record_id", "left")
    resolution = F.lit("none")
    for name in ("event", "monthly", "daily", "hourly"):
        resolution = F.when(F.col(name), name).otherwise(resolution)
    status = (F.when(~F.col("hourly"), "SCREENED_OUT").when(~F.col("accessible"), "LOCKED").when(F.col("n").isNull(), "NOT_ACQUIRED").when(F.col("last_good").isNull(), "NO_GOOD_READING")
              .when(F.col("last_good") < F.lit("2018-01-01 00:00:00").cast("timestamp"), "INSUFFICIENT_TARGET_PERIOD").when(F.col("n") >= 500, "CORE").otherwise("EXTENDED"))
    return d.select("record_id", resolution.alias("resolution"), status.alias("status"))


@query(f"""with {_CAND} select record_id, regexp_replace(regexp_replace(wmo_region, '^REGION [IV]+ \\(', ''), '\\)$', '') as region,
  coalesce(case regexp_extract(wmo_region, '^REGION ([IV]+) ', 1) when 'I' then 'Africa' when 'II' then 'Asia' when 'III' then 'South America'
    when 'IV' then 'North and Central America' when 'V' then 'South-West Pacific' when 'VI' then 'Europe' end, 'UNKNOWN') as continent,
  case when gas = 'CO2' then 'ppm/yr' else 'ppb/yr' end as unit from c""")
def b10_region(spark, sf_dir):
    return _candidates(spark, sf_dir).select("record_id", fx.region_name(F.col("wmo_region")).alias("region"), fx.continent(F.col("wmo_region")).alias("continent"), fx.unit_label(F.col("gas"), True).alias("unit"))


@query(f"""with {_CAND} select record_id, try_cast(regexp_extract(trim(elevation), '^[-+]?[0-9.]+([eE][-+]?[0-9]+)?') as double) as elevation_m from c""")
def b21_elevation(spark, sf_dir):
    return _candidates(spark, sf_dir).select("record_id", fx.lenient_number(F.col("elevation")).alias("elevation_m"))


@query("""select record_id || ' ' || m || ' k=' || k as configuration, record_id, m as method, k from (select distinct record_id from obs_parsed),
  (select unnest(['seasonal_mad', 'rolling_seasonal_mad', 'hampel_7day', 'iqr_hour']) m), (select unnest([3, 4, 5]) k)""")
def b19_configurations(spark, sf_dir):
    d = _t(spark, sf_dir, "obs_parsed").select("record_id").distinct()
    d = d.withColumn("method", F.explode(F.array(*[F.lit(m) for m in ("seasonal_mad", "rolling_seasonal_mad", "hampel_7day", "iqr_hour")]))).withColumn("k", F.explode(F.array(*[F.lit(k) for k in (3, 4, 5)])))
    return d.select(F.concat(F.col("record_id"), F.lit(" "), F.col("method"), F.lit(" k="), F.col("k")).alias("configuration"), "record_id", "method", "k")


@query(f"""with {_CAND}, meta as (select record_id, unit, lst_to_utc_hours, species from text_layout)
select c.record_id, upper(trim(c.station_name)) as station, coalesce(nullif(trim(c.country), ''), 'UNKNOWN') as country, coalesce(c.contributor, c.metadata_contributor) as contributor, unit, lst_to_utc_hours
from c left join meta on c.record_id = meta.record_id and upper(c.gas) = upper(species)""")
def c01_catalogue_join(spark, sf_dir):
    meta = _t(spark, sf_dir, "text_layout").select(F.col("record_id").alias("_r"), "unit", "lst_to_utc_hours", "species")
    d = _candidates(spark, sf_dir)
    d = d.join(meta, (d.record_id == F.col("_r")) & (F.upper("gas") == F.upper("species")), "left")
    return d.select("record_id", F.upper(F.trim("station_name")).alias("station"), F.coalesce(F.nullif(F.trim("country"), F.lit("")), F.lit("UNKNOWN")).alias("country"),
                    F.coalesce("contributor", "metadata_contributor").alias("contributor"), "unit", "lst_to_utc_hours")


_GOOD = "qc_valid and value is not null and not isnan(value) and timestamp_utc is not null"


@query(f"""select record_id, year(timestamp_utc) * 12 + month(timestamp_utc) - 1 as mo, count(*) as n_all, count(value) as n_value, count(*) filter ({_GOOD}) as n_good,
  min(epoch_us(timestamp_utc)) as first_us, max(epoch_us(timestamp_utc)) as last_us, round(avg(value) filter ({_GOOD}), 5) as mean
from obs_parsed where timestamp_utc is not null group by 1, 2""")
def d01_monthly_fold(spark, sf_dir):
    from skytally.sources.tables import good_reading

    d = _t(spark, sf_dir, "obs_parsed").where("timestamp_utc is not null")
    return d.groupBy("record_id", fx.month_ordinal(F.col("timestamp_utc")).cast("long").alias("mo")).agg(
        F.count(F.lit(1)).alias("n_all"), F.count("value").alias("n_value"), F.sum(good_reading().cast("long")).alias("n_good"),
        F.min(F.unix_micros("timestamp_utc")).alias("first_us"), F.max(F.unix_micros("timestamp_utc")).alias("last_us"),
        F.round(F.avg(F.when(good_reading(), F.col("value"))), 5).alias("mean"))


FIRST, MONTHS = 1995 * 12, 72
WITHIN, STATION = [0.02, 0.05, 0.08, 0.12], [0.5, 0.6, 0.7, 0.8]
_DENSE = f"""dense as (select p.place, p.region, p.gas, g.mo, coalesce(m.n, 0) as n, coalesce(m.days, 0) as days, m.mean,
  day(last_day(make_date((g.mo // 12)::int, (g.mo % 12 + 1)::int, 1))) as expected,
  coalesce(m.days, 0) / day(last_day(make_date((g.mo // 12)::int, (g.mo % 12 + 1)::int, 1))) as coverage
  from (select distinct place, region, gas from monthly) p, (select unnest(range({FIRST}, {FIRST + MONTHS})) as mo) g
  left join monthly m on m.place = p.place and m.region = p.region and m.gas = p.gas and m.mo = g.mo)"""


def _dense(spark, sf_dir, by="station"):
    return cohort.dense_months(monthly(spark, sf_dir, by), ["place", "region", "gas"], FIRST, MONTHS)


@query(f"with {monthly_sql()}, {_DENSE} select place, gas, mo, n, days, expected, round(coverage, 9) as coverage, coverage >= 0.05 as qualified from dense")
def c09_dense_months(spark, sf_dir):
    return cohort.qualify(_dense(spark, sf_dir), 0.05).select("place", "gas", "mo", "n", "days", "expected", F.round("coverage", 9).alias("coverage"), "qualified")


_FRACTION = f"""fraction as (select place, region, gas, within, avg((coverage >= within)::int::double) as fraction from dense, (select unnest({WITHIN}::double[]) as within) group by all)"""


@query(f"with {monthly_sql()}, {_DENSE}, {_FRACTION} select place, gas, within, round(fraction, 9) as fraction from fraction")
def d02_coverage(spark, sf_dir):
    d = cohort.qualified_fractions(_dense(spark, sf_dir), ["place", "region", "gas"], WITHIN)
    return d.select("place", "gas", "within", F.round("fraction", 9).alias("fraction"))


@query(f"""with {monthly_sql()}, {_DENSE}, {_FRACTION},
kept as (select within, station, place, count(*) filter (fraction >= station) as kept, count(distinct gas) filter (fraction >= station) as gases, max(region) filter (fraction >= station) as region
  from fraction, (select unnest({STATION}::double[]) as station) group by all)
select within, station, sum(kept)::bigint as datasets, count(*) filter (kept > 0) as places, count(*) filter (gases >= 2) as paired,
  coalesce(array_to_string(list_sort(list(distinct region) filter (region is not null)), ';'), '') as regions from kept group by all""")
def d05_grid(spark, sf_dir):
    d = cohort.qualified_fractions(_dense(spark, sf_dir), ["place", "region", "gas"], WITHIN)
    return cohort.threshold_grid(d, STATION)


@query(f"""with {monthly_sql()}, {_DENSE} select place, region, round(sum(mean * n) filter (coverage >= 0.05 and mean is not null and n > 0) / sum(n) filter (coverage >= 0.05 and mean is not null and n > 0), 4) as weighted,
  count(*) filter (coverage >= 0.05) as qualified from dense group by 1, 2""")
def d12_weighted_mean(spark, sf_dir):
    ok = F.col("coverage") >= 0.05
    return _dense(spark, sf_dir).groupBy("place", "region").agg(F.round(cohort.weighted_mean("mean", "n", ok), 4).alias("weighted"), F.sum(ok.cast("long")).alias("qualified"))


@query(f"""with {monthly_sql()}, {_DENSE},
p as (select place, region, gas, avg(mean) as mean, avg((coverage >= 0.05)::int::double) as fraction from dense group by all)
select region, gas, count(distinct place) as places, round(median(mean), 4) as median_mean, round(min(mean), 4) as min_mean, round(max(mean), 4) as max_mean, round(median(fraction), 9) as median_fraction,
  count(distinct place) < 3 as context_only from p group by 1, 2""")
def d13_region(spark, sf_dir):
    p = _dense(spark, sf_dir).groupBy("place", "region", "gas").agg(F.avg("mean").alias("mean"), F.avg((F.col("coverage") >= 0.05).cast("double")).alias("fraction"))
    return p.groupBy("region", "gas").agg(
        F.countDistinct("place").alias("places"), F.round(F.median("mean"), 4).alias("median_mean"), F.round(F.min("mean"), 4).alias("min_mean"), F.round(F.max("mean"), 4).alias("max_mean"),
        F.round(F.median("fraction"), 9).alias("median_fraction"), (F.countDistinct("place") < 3).alias("context_only"))


@query(f"""with {monthly_sql()}, {_DENSE},
c as (select *, coverage < 0.05 as bad, coalesce(((coverage < 0.05) <> lag(coverage < 0.05) over w)::int, 0) as ch from dense window w as (partition by place, region, gas order by mo)),
r as (select *, sum(ch) over (partition by place, region, gas order by mo) as run from c),
runs as (select place, region, gas, run, count(*) filter (bad) as bad, count(*) as months, count(*) filter (days = 0) as zero from r group by all)
select place, gas, (sum(months) - sum(bad))::bigint as qualified_months, sum(zero)::bigint as zero_months, max(bad) as longest_bad, max(bad) >= 3 as clustered from runs group by 1, 2""")
def d14_bad_runs(spark, sf_dir):
    return cohort.bad_runs(_dense(spark, sf_dir), ["place", "region", "gas"], 0.05).drop("region")


@query("""select record_id, count(*) as n, count(value) as n_value, count(*) filter (qc_valid) as n_valid, round(count(*) filter (qc_valid) / count(*), 9) as valid_fraction, count(value) - count(*) filter (qc_valid and value is not null) as n_invalid
from obs_parsed group by 1""")
def d08_qc_summary(spark, sf_dir):
    v = F.coalesce(F.col("qc_valid"), F.lit(False))
    return _t(spark, sf_dir, "obs_parsed").groupBy("record_id").agg(
        F.count(F.lit(1)).alias("n"), F.count("value").alias("n_value"), F.sum(v.cast("long")).alias("n_valid"), F.round(F.avg(v.cast("double")), 9).alias("valid_fraction"),
        (F.count("value") - F.sum((v & F.col("value").isNotNull()).cast("long"))).alias("n_invalid"))


@query(f"""with {_CAND}, f as (select gas, wmo_category, regexp_matches(wmo_region, 'Europe') as european, * from c)
select gas, 'CORE' as cohort, count(*) as datasets, count(distinct wdcgg_id) as stations from c where wmo_category = 'GAW Global' group by 1
union all select gas, 'EXTENDED', count(*), count(distinct wdcgg_id) from c where wmo_category in ('GAW Global', 'GAW Regional') group by 1""")
def d07_core_extended(spark, sf_dir):
    d = _candidates(spark, sf_dir)
    part = lambda cats, name: d.where(F.col("wmo_category").isin(*cats)).groupBy("gas").agg(F.count(F.lit(1)).alias("datasets"), F.countDistinct("wdcgg_id").alias("stations")).withColumn("cohort", F.lit(name))
    return part(["GAW Global"], "CORE").unionByName(part(["GAW Global", "GAW Regional"], "EXTENDED"))


@query(f"""with {_CAND} select wdcgg_id, min(upper(trim(station_name))) as station, min(latitude) as latitude, max(longitude) as longitude, array_to_string(list_sort(list(distinct gas)), '+') as gases,
  bool_and(wmo_category = 'GAW Global') as all_global from c group by 1""")
def d34_station_map(spark, sf_dir):
    return _candidates(spark, sf_dir).groupBy("wdcgg_id").agg(
        F.min(F.upper(F.trim("station_name"))).alias("station"), F.min("latitude").alias("latitude"), F.max("longitude").alias("longitude"),
        F.array_join(F.sort_array(F.collect_set("gas")), "+").alias("gases"), F.bool_and(F.col("wmo_category") == "GAW Global").alias("all_global"))


@query(f"""with {_CAND}, s as (select case when not hourly then 'NOT_HOURLY' when not accessible then 'LOCKED' when station_status is null then 'STATUS_UNKNOWN' else station_status end as reason from c)
select reason, count(*) as n from s group by 1""")
def d32_reasons(spark, sf_dir):
    d = _candidates(spark, sf_dir)
    return d.select(F.when(~F.col("hourly"), "NOT_HOURLY").when(~F.col("accessible"), "LOCKED").when(F.col("station_status").isNull(), "STATUS_UNKNOWN").otherwise(F.col("station_status")).alias("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


@query("""select record_id, row_id, rn from (select record_id, row_id, row_number() over (partition by record_id order by timestamp_utc nulls last, row_id) rn from obs_parsed) where rn <= 30000""")
def f02_head_n(spark, sf_dir):
    obs = _t(spark, sf_dir, "obs_parsed").select("record_id", "row_id", "timestamp_utc")
    sixteen_days = F.coalesce(F.floor(F.unix_micros("timestamp_utc") / (16 * 86_400_000_000)).cast("long"), F.lit(2**62))
    return head_rows(obs, "record_id", sixteen_days, [F.asc_nulls_last("timestamp_utc"), "row_id"], 30_000).select("record_id", "row_id", "rn")


@query("""select record_id, timestamp_source, row_id, line_no from (select *, row_number() over (partition by record_id, timestamp_source order by line_no, row_id) rn from obs_incoming) where rn = 1""")
def i06_keep_first(spark, sf_dir):
    return top_rows(_t(spark, sf_dir, "obs_incoming"), ["record_id", "timestamp_source"], ["line_no", "row_id"], 1).select("record_id", "timestamp_source", "row_id", "line_no")


@query("""select record_id, epoch_us(timestamp_utc) as us, count(*) as n from obs_parsed where timestamp_utc is not null group by 1, 2 having count(*) > 1""")
def i08_duplicates(spark, sf_dir):
    return _t(spark, sf_dir, "obs_parsed").where("timestamp_utc is not null").groupBy("record_id", F.unix_micros("timestamp_utc").alias("us")).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


@query("""(select record_id from obs_parsed except select record_id from candidate) union all (select record_id from text_layout intersect select record_id from raw_rows)""")
def i02_key_sets(spark, sf_dir):
    r = lambda n: _t(spark, sf_dir, n).select("record_id")
    return r("obs_parsed").subtract(r("candidate")).unionAll(r("text_layout").intersect(r("raw_rows")))


@query("""with d as (select o.row_id, o.value a, o.original_value * case when l.unit = 'ppm' and l.species = 'CH4' then 1e3 when l.unit in ('mol/mol', 'mol mol-1') and l.species = 'CO2' then 1e6
    when l.unit in ('mol/mol', 'mol mol-1') then 1e9 else 1.0 end b from obs_parsed o join text_layout l using (record_id) where o.value is not null and not isnan(o.value) and o.original_value is not null and not isnan(o.original_value))
select 'value' as "column", count(*) as "rows", 0::bigint as one_sided, count(*) filter (abs(a - b) > 0.01 + 1e-4 * abs(b)) as differing from d""")
def a20_diff(spark, sf_dir):
    lay = _t(spark, sf_dir, "text_layout").select("record_id", F.col("unit").alias("lu"), "species")
    known = "value is not null and not isnan(value) and original_value is not null and not isnan(original_value)"
    o = join_dimension(_t(spark, sf_dir, "obs_parsed").where(known).select("row_id", "record_id", "value", "original_value"), lay, ["record_id"], "inner")
    factor = F.when((F.col("lu") == "ppm") & (F.col("species") == "CH4"), 1e3).when(F.col("lu").isin("mol/mol", "mol mol-1"), F.when(F.col("species") == "CO2", 1e6).otherwise(1e9)).otherwise(1.0)
    left, right = o.select("row_id", "value"), o.select("row_id", (F.col("original_value") * factor).alias("value"))
    return diff.table_diff(left, right, ["row_id"], 1e-4, 0.01).drop("largest")


_SITE = f"""{_CAND}, site as (select gas, record_id as name, try_cast(latitude as double) lat, try_cast(longitude as double) lon, n as weight from c join (select record_id, count(*) filter ({_GOOD}) n from obs_parsed group by 1) using (record_id))"""


@query(f"""with recursive {_SITE},
pick as (
  select gas, 1 as place, name, lat, lon, [name] as names, [lat] as lats, [lon] as lons from (select *, row_number() over (partition by gas order by weight desc, name) rn from site) where rn = 1
  union all
  select gas, place, name, lat, lon, names, lats, lons from (
    select p.gas, p.place + 1 as place, s.name, s.lat, s.lon, list_append(p.names, s.name) as names, list_append(p.lats, s.lat) as lats, list_append(p.lons, s.lon) as lons,
      row_number() over (partition by p.gas order by round(list_min(list_transform(range(1, len(p.lats) + 1), lambda i: sqrt(((s.lat - p.lats[i]) / 90)**2 + (least(abs(s.lon - p.lons[i]), 360 - abs(s.lon - p.lons[i])) / 180)**2))), 12) desc, s.weight desc, s.name) rn
    from pick p join site s on s.gas = p.gas and not list_contains(p.names, s.name) where p.place < 5) where rn = 1)
select gas, place, name from pick""")
def f07_farthest(spark, sf_dir):
    from skytally.sources.tables import good_reading

    n = _t(spark, sf_dir, "obs_parsed").groupBy("record_id").agg(F.sum(good_reading().cast("long")).alias("weight"))
    d = _candidates(spark, sf_dir).join(n, "record_id").select("gas", F.col("record_id").alias("name"), F.col("latitude").try_cast("double").alias("lat"), F.col("longitude").try_cast("double").alias("lon"), "weight")
    return farthest_points(d, "gas", "name", "lat", "lon", "weight", 5).select("gas", "place", "name")
