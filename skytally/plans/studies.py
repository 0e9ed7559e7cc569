"""Queries that join several operators: selections, summaries of method tests, block inference, sensitivity (rest of C, D, E, F, H, J)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from skytally.functions import columns as fx
from skytally.operators import detect, evaluate, fill, resample, trend
from skytally.operators import sequences as seq
from skytally.operators.skew import previous
from skytally.plans import series as s
from skytally.plans.catalogue import _CAND, _GOOD, _candidates
from skytally.plans.domain import HOURLY, hourly, monthly, monthly_sql
from skytally.session import cut, prepare
from skytally.sources.tables import good_reading, table

QUERIES: dict = {}
SQL: dict[str, str] = {}
REGION = monthly_sql("region")


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f
    return add


@query(f"""with {_CAND}, o as (select record_id, count(*) filter ({_GOOD}) as n from obs_parsed group by 1)
select record_id, case when n is null then 'NOT_ACQUIRED' when n >= 300 then 'FINAL' else 'ACQUIRED_NOT_FINAL' end as status, case when n >= 300 then 'enough readings' when n is null then 'no file' else 'too few readings' end as reason from c left join o using (record_id)""")
def b08_final_status(spark, sf_dir):
    o = table(prepare(spark), sf_dir, "obs_parsed").groupBy("record_id").agg(F.sum(good_reading().cast("long")).alias("n"))
    n = F.col("n")
    return _candidates(spark, sf_dir).join(o, "record_id", "left").select(
        "record_id", F.when(n.isNull(), "NOT_ACQUIRED").when(n >= 300, "FINAL").otherwise("ACQUIRED_NOT_FINAL").alias("status"),
        F.when(n >= 300, "enough readings").when(n.isNull(), "no file").otherwise("too few readings").alias("reason"))


@query(f"""with {HOURLY}, sp as (select record_id, min(h) lo, max(h) hi from hourly group by 1), g as (select record_id, unnest(range(lo, hi + 1)) as h from sp)
select record_id, h, v from g left join hourly using (record_id, h)""")
def c10_dense_hours(spark, sf_dir):
    return fill.dense_hours(hourly(spark, sf_dir).select("record_id", "h", "v"), "record_id", "h")


@query(f"""with a as (select gas, gap_hours, method, median(median_rmse) as early from gap_method_summary where {s._OK} and run_day < date '2022-02-15' group by 1, 2, 3),
b as (select gas, gap_hours, method, median(median_rmse) as late from gap_method_summary where {s._OK} and run_day >= date '2022-02-15' group by 1, 2, 3)
select gas, gap_hours, method, round(early, 10) as early, round(late, 10) as late, round(late - early, 9) as shift from a join b using (gas, gap_hours, method)""")
def c15_early_late(spark, sf_dir):
    d = table(prepare(spark), sf_dir, "gap_method_summary").where(s._OK)
    early = F.col("run_day") < F.lit("2022-02-15").cast("date")
    half = lambda c, n: d.where(c).groupBy("gas", "gap_hours", "method").agg(F.median("median_rmse").alias(n))
    j = half(early, "early").join(half(~early, "late"), ["gas", "gap_hours", "method"])
    return j.select("gas", "gap_hours", "method", F.round("early", 10).alias("early"), F.round("late", 10).alias("late"), F.round(F.col("late") - F.col("early"), 9).alias("shift"))


@query(f"""with {monthly_sql()}, p as (select place, count(distinct gas) filter (n >= 2) as gases, sum(n)::bigint as n from monthly group by 1) select gases, count(*) as places, sum(n)::bigint as n from p group by 1""")
def d06_paired(spark, sf_dir):
    p = monthly(spark, sf_dir).groupBy("place").agg(F.countDistinct(F.when(F.col("n") >= 2, F.col("gas"))).alias("gases"), F.sum("n").alias("n"))
    return p.groupBy("gases").agg(F.count(F.lit(1)).alias("places"), F.sum("n").alias("n"))


@query(f"""with {s._score_sql()}, t as (select configuration, {s._M} from sc group by 1), {s._lexi_sql('(select *, 1 as one from t)', 'one', 'best')},
r as (select configuration, f1, row_number() over (order by f1 desc, configuration) as rk from t)
select b.configuration, b.f1, b.fpr, round(b.f1 - (select f1 from r where rk = 2), 9) as margin from best b""")
def d20_operational(spark, sf_dir):
    m = [F.round(F.avg(c), 9).alias(c) for c in ("f1", "fpr", "recall", "prec")]
    t = cut(s._scores(spark, sf_dir).groupBy("configuration").agg(*m).withColumn("one", F.lit(1)))
    best = seq.pick_with_tolerance(t, ["one"], s.RULES, "configuration", s.TOL)
    second = seq.top_rows(t, ["one"], [F.desc("f1"), "configuration"], 2).where("rn = 2").select("one", F.col("f1").alias("second"))
    return best.join(second, "one").select("configuration", "f1", "fpr", F.round(F.col("f1") - F.col("second"), 9).alias("margin"))


@query(f"""with {s._score_sql()}, m as (select split_part(configuration, ' ', 1) as method, split_part(configuration, 'k=', 2)::int as k, round(avg(f1), 9) as f1 from sc group by 1, 2)
select method, k, f1 from (select *, row_number() over (partition by method order by f1 desc, k) rn from m) where rn = 1""")
def d23_best_k(spark, sf_dir):
    m = s._scores(spark, sf_dir).groupBy(F.substring_index("configuration", " ", 1).alias("method"), F.substring_index("configuration", "k=", -1).cast("int").alias("k")).agg(F.round(F.avg("f1"), 9).alias("f1"))
    return seq.top_rows(m, ["method"], [F.desc("f1"), "k"], 1).select("method", "k", "f1")


@query(f"""select gas, gap_hours, method, count(distinct physical_stations) as stations, round(median(median_rmse), 10) as med, round(avg(median_rmse) + 1.2345e-9, 6) as mean, round(quantile_cont(median_rmse, 0.75) - quantile_cont(median_rmse, 0.25), 9) as iqr, round(median(median_mae), 10) as mae
from gap_method_summary where {s._OK} group by 1, 2, 3""")
def d26_stratum(spark, sf_dir):
    d = table(prepare(spark), sf_dir, "gap_method_summary").where(s._OK)
    q = F.percentile("median_rmse", F.array(F.lit(0.25), F.lit(0.75)))
    return d.groupBy("gas", "gap_hours", "method").agg(
        F.countDistinct("physical_stations").alias("stations"), F.round(F.median("median_rmse"), 10).alias("med"), F.round(F.avg("median_rmse") + 1.2345e-9, 6).alias("mean"),
        F.round(q[1] - q[0], 9).alias("iqr"), F.round(F.median("median_mae"), 10).alias("mae"))


@query(f"""with x as (select gas, method, physical_stations, gap_hours, median(median_rmse) m, count(*) n from gap_method_summary where {s._OK} and physical_stations is not null group by 1, 2, 3, 4)
select gas, method, physical_stations, count(*) as strata, sum(n)::bigint as n, round(median(m), 10) as med from x group by 1, 2, 3""")
def d27_station(spark, sf_dir):
    d = table(prepare(spark), sf_dir, "gap_method_summary").where(s._OK + " and physical_stations is not null")
    x = d.groupBy("gas", "method", "physical_stations", "gap_hours").agg(F.median("median_rmse").alias("m"), F.count(F.lit(1)).alias("n"))
    return x.groupBy("gas", "method", "physical_stations").agg(F.count(F.lit(1)).alias("strata"), F.sum("n").alias("n"), F.round(F.median("m"), 10).alias("med"))


@query("""select gas, method, count(*) as n, count(*) filter (median_rmse is not null and not isnan(median_rmse)) as succeeded, count(*) filter (isnan(median_rmse)) as failed, count(*) filter (median_mae is not null) as with_mae from gap_method_summary group by 1, 2""")
def d30_execution(spark, sf_dir):
    n = lambda c, a: F.sum(F.coalesce(c, F.lit(False)).cast("long")).alias(a)
    return table(prepare(spark), sf_dir, "gap_method_summary").groupBy("gas", "method").agg(
        F.count(F.lit(1)).alias("n"), n(F.col("median_rmse").isNotNull() & ~F.isnan("median_rmse"), "succeeded"), n(F.isnan("median_rmse"), "failed"), n(F.col("median_mae").isNotNull(), "with_mae"))


@query(f"""with {_CAND} select count(*) as records, count(distinct wdcgg_id) as stations, count(*) filter (hourly) as hourly, count(*) filter (accessible) as accessible, count(distinct gas) as gases,
  array_to_string(list_sort(list(distinct wmo_category)), ';') as categories from c""")
def d33_discovery(spark, sf_dir):
    n = lambda c: F.sum(F.col(c).cast("long")).alias(c)
    return _candidates(spark, sf_dir).agg(F.count(F.lit(1)).alias("records"), F.countDistinct("wdcgg_id").alias("stations"), n("hourly"), n("accessible"), F.countDistinct("gas").alias("gases"),
                                          F.array_join(F.sort_array(F.collect_set("wmo_category")), ";").alias("categories"))


@query(f"""with {HOURLY}, {s._ONE}, dd as (select record_id, h // 24 as d, avg(v) filter (not filled) as a, avg(v) as b from one group by 1, 2)
select record_id, count(*) as days, round(avg(abs(b - a)), 6) as mean_change, round(max(abs(b - a)), 6) as max_change from dd where a is not null group by 1""")
def d35_sensitivity(spark, sf_dir):
    d = fill.one_hour_fill(hourly(spark, sf_dir), "record_id", "h", "v")
    x = d.groupBy("record_id", F.floor(F.col("h") / 24).alias("d")).agg(F.avg(F.when(~F.col("filled"), F.col("v"))).alias("a"), F.avg("v").alias("b")).where("a is not null")
    c = F.abs(F.col("b") - F.col("a"))
    return x.groupBy("record_id").agg(F.count(F.lit(1)).alias("days"), F.round(F.avg(c), 6).alias("mean_change"), F.round(F.max(c), 6).alias("max_change"))


@query(f"""with {HOURLY}, d as (select record_id, v - lag(v) over (partition by record_id order by h) as d from hourly), m as (select record_id, median(d) as m from d where d is not null group by 1)
select record_id, count(*) as n, round(1.4826 * median(abs(d - m)), 6) as noise from d join m using (record_id) where d is not null group by 1""")
def e11_noise(spark, sf_dir):
    from skytally.operators.rolling import group_median

    d = previous(hourly(spark, sf_dir).select("record_id", "h", "v"), "record_id", F.floor(F.col("h") / 4096).cast("long"), ["h"], ["v"])
    d = d.select("record_id", (F.col("v") - F.col("prev.v")).alias("d")).where("d is not null")
    return group_median(d, ["record_id"], "d", "m").groupBy("record_id").agg(F.count(F.lit(1)).alias("n"), F.round(1.4826 * F.median(F.abs(F.col("d") - F.col("m"))), 6).alias("noise"))


@query(f"""with {s._DAY}, l as (select *, m = min(m) over (partition by run_day, gas, gap_hours) as low from day), {s._COND}, r as (select gas, gap_hours, method, rank() over (partition by gas, gap_hours order by rmse) as rank_rmse from cond)
select l.gas, l.gap_hours, l.method, max(rank_rmse) as rank_rmse, count(*) as days, count(*) filter (low) as days_lowest, round(count(*) filter (low) / count(*), 9) as share from l join r using (gas, gap_hours, method) group by 1, 2, 3""")
def e14_rank_stability(spark, sf_dir):
    low = s._daily(spark, sf_dir).withColumn("low", F.col("m") == F.min("m").over(Window.partitionBy("run_day", "gas", "gap_hours")))
    r = s._conditions(spark, sf_dir).withColumn("rank_rmse", F.rank().over(Window.partitionBy("gas", "gap_hours").orderBy("rmse")).cast("long")).select("gas", "gap_hours", "method", "rank_rmse")
    return low.join(r, ["gas", "gap_hours", "method"]).groupBy("gas", "gap_hours", "method").agg(
        F.max("rank_rmse").alias("rank_rmse"), F.count(F.lit(1)).alias("days"), F.sum(F.col("low").cast("long")).alias("days_lowest"), F.round(F.avg(F.col("low").cast("double")), 9).alias("share"))


@query(f"with {HOURLY} select record_id, h, v from (select *, row_number() over (order by v desc, record_id, h) rn from hourly) where rn <= 8")
def f03_highest(spark, sf_dir):
    return hourly(spark, sf_dir).orderBy(F.desc("v"), "record_id", "h").limit(8).select("record_id", "h", "v")


@query(f"""with {HOURLY}, b as (select record_id, h // 24 as day, avg(v) as a from hourly group by 1, 2), p as (select x.record_id, (y.a - x.a) / ((y.day - x.day) / 365.2425) as sl from b x join b y on x.record_id = y.record_id and x.day < y.day)
select record_id, count(*) as n_pairs, round(median(sl), 4) as slope from p group by 1 having count(*) >= 3""")
def h02_daily_sen(spark, sf_dir):
    d = hourly(spark, sf_dir).groupBy("record_id", F.floor(F.col("h") / 24).cast("long").alias("day")).agg(F.avg("v").alias("a"))
    p = trend.sen_by_key(d, "record_id", "day", "a", 365.2425)
    return p.select("record_id", "n_pairs", F.round("slope", 4).alias("slope")).where("n_pairs >= 3")


@query(f"""with {s._COND}, {s._BOOT}, e as (select gas, method, median(rmse) est from cond group by 1, 2)
select gas, method, round(max(est), 10) as estimate, round(quantile_cont(stat, 0.025), 6) as low, round(quantile_cont(stat, 0.975), 6) as high, round(2 * max(est) - quantile_cont(stat, 0.975), 6) as basic_low, round(2 * max(est) - quantile_cont(stat, 0.025), 6) as basic_high,
  round(max(est) - 1.959963984540054 * stddev_samp(stat), 6) as normal_low, round(max(est) + 1.959963984540054 * stddev_samp(stat), 6) as normal_high from stats join e using (gas, method) group by 1, 2""")
def h09_intervals(spark, sf_dir):
    c = cut(s._conditions(spark, sf_dir))
    stats = resample.bootstrap_statistic(c, ["gas", "method"], "gap_hours", "rmse", s.BLOCKS, "block", F.median("x"))
    est = c.groupBy("gas", "method").agg(F.median("rmse").alias("est"))
    d = trend.percentile_interval(stats.join(est, ["gas", "method"]), ["gas", "method"], "stat", F.col("est"))
    return d.select("gas", "method", F.round("estimate", 10).alias("estimate"), *[F.round(c, 6).alias(c) for c in ("low", "high", "basic_low", "basic_high", "normal_low", "normal_high")])


@query(f"""with {_CAND}, {HOURLY}, st as (select record_id, gas, median(v) med, stddev_samp(v) sd, count(*)::double n from hourly group by 1, 2), x as (select st.gas, try_cast(c.latitude as double) lat, med, sd, n from st join c using (record_id)),
long as (select gas, 'median' as relation, lat, med as y from x union all select gas, 'scatter', lat, sd from x union all select gas, 'hours', lat, n from x),
r as (select gas, relation, rank() over (partition by gas, relation order by lat) + (count(*) over (partition by gas, relation, lat) - 1) / 2.0 a, rank() over (partition by gas, relation order by y) + (count(*) over (partition by gas, relation, y) - 1) / 2.0 b from long where lat is not null and y is not null)
select gas, relation, count(*) as n, round(corr(a, b), 8) as rho from r group by 1, 2""")
def h14_latitude(spark, sf_dir):
    st = hourly(spark, sf_dir).groupBy("record_id", "gas").agg(F.median("v").alias("med"), F.stddev("v").alias("sd"), F.count(F.lit(1)).cast("double").alias("cnt"))
    c = _candidates(spark, sf_dir).select("record_id", F.col("latitude").try_cast("double").alias("lat"))
    x = st.join(c, "record_id")
    long = x.select("gas", "lat", F.inline(F.array(*[F.struct(F.lit(n).alias("relation"), F.col(k).alias("y")) for n, k in (("median", "med"), ("scatter", "sd"), ("hours", "cnt"))])))
    return seq.spearman(long, ["gas", "relation"], "lat", "y").select("gas", "relation", "n", F.round("rho", 8).alias("rho"))


@query(f"""with {s._score_sql()}, fold as (select substr(record_id, 1, 4) as station, configuration, avg(f1) f1, avg(fpr) fpr from sc group by 1, 2), mem as (select *, row_number() over (partition by configuration order by station) - 1 as draw, count(*) over (partition by configuration) as size from fold),
dr as (select configuration, rep, slot, ('0x' || substr(sha256('station|' || rep::varchar || '|' || slot::varchar), 1, 15))::bigint % size as draw from (select distinct configuration, size from mem), (select unnest(range({s.STATIONS})) rep), (select unnest(range(100)) slot) where slot < size),
st as (select configuration, rep, avg(f1) f1, avg(fpr) fpr from dr join mem using (configuration, draw) group by 1, 2)
select configuration, count(*) as reps, round(quantile_cont(f1, 0.025), 7) as f1_low, round(quantile_cont(f1, 0.975), 7) as f1_high, round(quantile_cont(fpr, 0.025), 7) as fpr_low, round(quantile_cont(fpr, 0.975), 7) as fpr_high from st group by 1""")
def j06_station_bootstrap(spark, sf_dir):
    """All metrics of a replicate share its draw of stations."""
    fold = s._scores(spark, sf_dir).groupBy(F.substring("record_id", 1, 4).alias("station"), "configuration").agg(F.avg("f1").alias("f1"), F.avg("fpr").alias("fpr"))
    mem = cut(fold.withColumn("draw", (F.row_number().over(Window.partitionBy("configuration").orderBy("station")) - 1).cast("long")))
    size = mem.groupBy("configuration").agg(F.count(F.lit(1)).alias("size"))
    st = resample.replicates(size, "size", s.STATIONS, "station").join(mem, ["configuration", "draw"]).groupBy("configuration", "rep").agg(F.avg("f1").alias("f1"), F.avg("fpr").alias("fpr"))
    p = lambda c, q: F.round(F.percentile(c, F.lit(q)), 7)
    return st.groupBy("configuration").agg(F.count(F.lit(1)).alias("reps"), p("f1", 0.025).alias("f1_low"), p("f1", 0.975).alias("f1_high"), p("fpr", 0.025).alias("fpr_low"), p("fpr", 0.975).alias("fpr_high"))


_BLOCK_IN = f"""{s._DAY}, meth as (select gas, gap_hours, 'METHOD' as kind, method as who, run_day, m as x from day),
pairs as (select a.gas, a.gap_hours, 'PAIR' as kind, a.method || '-' || b.method as who, a.run_day, round(a.m - b.m, 9) as x from day a join day b on a.run_day = b.run_day and a.gas = b.gas and a.gap_hours = b.gap_hours and a.method < b.method),
al as (select * from meth union all select * from pairs), wk as (select gas, gap_hours, kind, who, date_diff('day', date '2022-01-01', run_day) // 30 as block, median(x) as x from al group by 1, 2, 3, 4, 5),
mem as (select *, row_number() over (partition by gas, gap_hours, kind, who order by block) - 1 as draw, count(*) over (partition by gas, gap_hours, kind, who) as size from wk),
dr as (select gas, gap_hours, kind, who, size, rep, slot, ('0x' || substr(sha256('inference|' || gas || '|' || gap_hours::varchar || '|' || kind || '|' || who || '|' || rep::varchar || '|' || slot::varchar), 1, 15))::bigint % size as draw
  from (select distinct gas, gap_hours, kind, who, size from mem), (select unnest(range({s.BLOCKS})) rep), (select unnest(range(20)) slot) where slot < size),
st as (select dr.gas, dr.gap_hours, dr.kind, dr.who, dr.size, rep, median(x) as stat from dr join mem using (gas, gap_hours, kind, who, draw) group by 1, 2, 3, 4, 5, 6)"""


@query(f"""with {_BLOCK_IN} select gas, gap_hours, kind, who, size, case when size < 3 then 'TOO_FEW_BLOCKS' else 'INTERVAL' end as status,
  round(case when size >= 3 then quantile_cont(stat, 0.025) end + 1.2345e-9, 7) as low, round(case when size >= 3 then quantile_cont(stat, 0.975) end + 1.2345e-9, 7) as high from st group by 1, 2, 3, 4, 5""")
def j08_block_inference(spark, sf_dir):
    d = s._daily(spark, sf_dir)
    meth = d.select("gas", "gap_hours", F.lit("METHOD").alias("kind"), F.col("method").alias("who"), "run_day", F.col("m").alias("x"))
    a, b = d.withColumnsRenamed({"method": "ma", "m": "xa"}), d.withColumnsRenamed({"method": "mb", "m": "xb"})
    pairs = a.join(b, ["run_day", "gas", "gap_hours"]).where("ma < mb").select(
        "gas", "gap_hours", F.lit("PAIR").alias("kind"), F.concat_ws("-", "ma", "mb").alias("who"), "run_day", F.round(F.col("xa") - F.col("xb"), 9).alias("x"))
    key = ["gas", "gap_hours", "kind", "who"]
    block = F.floor(F.date_diff("run_day", F.lit("2022-01-01").cast("date")) / 30)
    wk = cut(meth.unionByName(pairs).groupBy(*key, block.alias("block")).agg(F.median("x").alias("x")))
    stats = resample.bootstrap_statistic(wk, key, "block", "x", s.BLOCKS, "inference", F.median("x"))
    size = wk.groupBy(*key).agg(F.count(F.lit(1)).alias("size"))
    out = resample.interval(stats, key, size, 3)
    return out.select(*key, "size", F.when(F.col("size") < 3, "TOO_FEW_BLOCKS").otherwise("INTERVAL").alias("status"), F.round(F.col("low") + 1.2345e-9, 7).alias("low"), F.round(F.col("high") + 1.2345e-9, 7).alias("high"))


_HODS = "partition by series, h % 24"
_WINDOW = "(partition by series order by h rows between {0} preceding and {0} following)"


def _judged_injections() -> str:
    """Flags of the twelve configurations over the injected series, and their counts, as SQL."""
    roll = lambda name, source, x, half, least: (
        f"{name}c as (select *, case when count({x}) over w >= {least} then median({x}) over w end as centre from {source} window w as {_WINDOW.format(half)}), "
        f"{name} as (select *, case when count(abs({x} - centre)) over w >= {least} then median(abs({x} - centre)) over w end as scale from {name}c window w as {_WINDOW.format(half)})")
    parts = []
    for k in (3, 4, 5):
        parts += [f"select 'seasonal_mad k={k}' as configuration, series, truth, abs(r) > {k} * greatest(1.4826 * s, 1e-9) as flag from c3",
                  f"select 'iqr_hour k={k}', series, truth, x < qa - {k} * 0.5 * (qb - qa) - 1e-9 or x > qb + {k} * 0.5 * (qb - qa) + 1e-9 from q3",
                  f"select 'hampel_7day k={k}', series, truth, coalesce(abs(x - centre) > {k} * greatest(1.4826 * scale, 1e-9), false) from hs",
                  f"select 'rolling_seasonal_mad k={k}', series, truth, coalesce(abs(r - centre) > {k} * greatest(1.4826 * scale, 1e-9), false) from rs"]
    return f"""{s._INJECT}, x0 as (select event || '|' || repetition::varchar || '|' || record_id as series, h, injected as x, truth from inj),
a3 as (select *, x - median(x) over ({_HODS}) r from x0), b3 as (select *, abs(r - median(r) over ({_HODS})) as dev from a3), c3 as (select *, median(dev) over ({_HODS}) s from b3),
q3 as (select *, quantile_cont(x, 0.25) over ({_HODS}) qa, quantile_cont(x, 0.75) over ({_HODS}) qb from x0), {roll("hs", "x0", "x", 84, 48)}, {roll("rs", "a3", "r", 168, 72)},
fl as ({" union all ".join(parts)}), cf as (select configuration, series, {s._COUNTS} from fl group by 1, 2),
pr as (select *, tp + fn > 0 as positive, case when tp + fp > 0 then tp / (tp + fp) else 0 end as prec0, case when tp + fn > 0 then tp / (tp + fn) else 0 end as rec0, case when fp + tn > 0 then fp / (fp + tn) else 0 end as fpr0 from cf)"""


@query(f"""with {_judged_injections()} select configuration, split_part(series, '|', 3) as record_id, split_part(series, '|', 1) as event, split_part(series, '|', 2)::int as repetition, case when positive then 'POSITIVE' else 'EMPTY' end as domain,
  tp, fp, fn, tn, case when positive then round(prec0, 6) end as prec, case when positive then round(rec0, 6) end as recall, case when positive then round(case when prec0 + rec0 > 0 then 2 * prec0 * rec0 / (prec0 + rec0) else 0 end, 6) end as f1, round(fpr0, 6) as fpr from pr""")
def j12_detector_evaluation(spark, sf_dir):
    """The five injected events against all four detectors at k = 3, 4 and 5, per record, event and repetition.

    Without truth only the rate of false flags has a meaning; the others are null.
    """
    d = detect.rates(evaluate.injected_counts(s._segment(spark, sf_dir), "record_id", "pos", "h", "v", s.REPETITIONS, "injection"))
    some = F.col("tp") + F.col("fn") > 0
    d = d.select("configuration", "record_id", "copies", F.when(some, "POSITIVE").otherwise("EMPTY").alias("domain"), "tp", "fp", "fn", "tn",
                 *[F.round(F.when(some, F.col(c)), 6).alias(c) for c in ("prec", "recall", "f1")], F.round("fpr", 6).alias("fpr"))
    return evaluate.each_copy(d, s.REPETITIONS).select("configuration", "record_id", "event", "repetition", "domain", "tp", "fp", "fn", "tn", "prec", "recall", "f1", "fpr")


@query(f"""with {_CAND} select record_id, lower(gas) || '_' || lower(wdcgg_id) as candidate_id, wdcgg_id || '_' || gas as dataset_key, regexp_replace(wdcgg_id || '_' || gas, '_[^_]*$', '') as station from c""")
def k01_keys(spark, sf_dir):
    key = F.concat_ws("_", "wdcgg_id", "gas")
    return _candidates(spark, sf_dir).select("record_id", F.concat_ws("_", F.lower("gas"), F.lower("wdcgg_id")).alias("candidate_id"), key.alias("dataset_key"), fx.physical_station(key).alias("station"))
