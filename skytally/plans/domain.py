"""Domain views over the given tables, each as a DataFrame and as SQL text of the same meaning."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skytally.functions.columns import month_days, month_ordinal
from skytally.session import prepare
from skytally.sources.tables import good_reading, table

#: Values at or below this mean "no value", as in the reference.
SENTINEL = -999.0


def _hour():
    return F.floor(F.unix_micros("timestamp_utc") / 3_600_000_000).cast("long").alias("h")


def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(record_id, gas, h, v, n): mean of an hour's good readings; h counts hours since 1970."""
    obs = table(prepare(spark), sf_dir, "obs_parsed").where(good_reading() & (F.col("value") > SENTINEL))
    return (obs.groupBy("record_id", F.when(F.col("unit") == "ppm", "CO2").otherwise("CH4").alias("gas"), _hour())
            .agg(F.round(F.avg("value"), 7).alias("v"), F.count(F.lit(1)).alias("n")))


def judged_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(record_id, h, v, truth): mean of an hour's numeric readings, whatever the provider says of them, and whether one of the hour's readings isn't good.

    v is null where an hour has no numeric reading. Such an hour isn't good, and no detector can flag it.
    """
    value = F.col("value")
    number = value.isNotNull() & ~F.isnan(value) & (value > SENTINEL)
    obs = table(prepare(spark), sf_dir, "obs_parsed").where("timestamp_utc is not null and record_id is not null")
    bad = ~F.coalesce(F.col("qc_valid") & number, F.lit(False))
    return obs.groupBy("record_id", _hour()).agg(F.round(F.avg(F.when(number, value)), 7).alias("v"), F.bool_or(bad).alias("truth"))


HOURLY = f"""hourly as (select record_id, case when unit = 'ppm' then 'CO2' else 'CH4' end as gas, epoch_us(timestamp_utc) // 3600000000 as h, round(avg(value), 7) as v, count(*) as n
  from obs_parsed where qc_valid and value is not null and not isnan(value) and timestamp_utc is not null and value > {SENTINEL}
  group by 1, 2, 3)"""

#: judged_hours as SQL.
JUDGED = f"""judged as (select record_id, epoch_us(timestamp_utc) // 3600000000 as h, round(avg(case when num then value end), 7) as v, bool_or(not coalesce(qc_valid and num, false)) as truth
  from (select *, value is not null and not isnan(value) and value > {SENTINEL} as num from obs_parsed where timestamp_utc is not null and record_id is not null) group by 1, 2)"""


def monthly(spark: SparkSession, sf_dir: str, by: str = "station") -> DataFrame:
    """(dataset, place, region, gas, mo, n, days, expected, coverage, mean) from dated orders.

    place is the nation (by='station') or the region. mo counts months from year 0.
    """
    spark = prepare(spark)
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderstatus", "o_orderdate", "o_totalprice")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    n = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    place = F.col("n_name" if by == "station" else "r_name")
    rows = o.join(c, o.o_custkey == c.c_custkey).join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    day = F.to_date("o_orderdate")
    agg = (rows.groupBy(place.alias("place"), F.col("r_name").alias("region"), F.col("o_orderstatus").alias("gas"), month_ordinal(day).cast("long").alias("mo"))
           .agg(F.count(F.lit(1)).alias("n"), F.countDistinct(day).alias("days"), F.round(F.avg("o_totalprice"), 8).alias("mean")))
    return (agg.withColumn("dataset", F.concat_ws("_", "place", "gas")).withColumn("expected", month_days(F.col("mo")).cast("long"))
            .withColumn("coverage", F.col("days") / F.col("expected")))


def monthly_sql(by: str = "station") -> str:
    place = "n_name" if by == "station" else "r_name"
    return f"""monthly as (select *, place || '_' || gas as dataset, day(last_day(make_date((mo // 12)::int, (mo % 12 + 1)::int, 1))) as expected,
    days / day(last_day(make_date((mo // 12)::int, (mo % 12 + 1)::int, 1))) as coverage from (
  select {place} as place, r_name as region, o_orderstatus as gas, year(o_orderdate) * 12 + month(o_orderdate) - 1 as mo,
    count(*) as n, count(distinct o_orderdate::date) as days, round(avg(o_totalprice), 8) as mean
  from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey
  group by 1, 2, 3, 4))"""
