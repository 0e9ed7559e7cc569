"""Queries on hourly and monthly series: windows, fills, detectors, trends, resampling (families E, G, H, I, J and the rest of D)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skytally.functions.columns import hash_draw
from skytally.operators import cohort, detect, fill, resample, trend
from skytally.operators import rolling as roll
from skytally.operators import sequences as seq
from skytally.plans.domain import HOURLY, JUDGED, hourly, judged_hours, monthly, monthly_sql
from skytally.session import cut, prepare, written
from skytally.sources.tables import table

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


# E: ordered sequences

_WIN = "over (partition by record_id order by h rows between {0} preceding and {0} following)"


def _rolling_sql(half: int, least: int, value: str = "v", source: str = "hourly") -> str:
    w = _WIN.format(half)
    return f"""c as (select *, case when count({value}) {w} >= {least} then median({value}) {w} end as centre from {source}),
s as (select *, case when count(abs({value} - centre)) {w} >= {least} then median(abs({value} - centre)) {w} end as scale from c)"""


@query(f"with {HOURLY}, {_rolling_sql(84, 48)} select record_id, h, round(centre, 6) as centre, round(scale, 6) as scale from s")
def e01_rolling_median(spark, sf_dir):
    d = roll.rolling_centre_and_scale(hourly(spark, sf_dir), "record_id", "h", "v", 84, 48)
    return d.select("record_id", "h", F.round("centre", 6).alias("centre"), F.round("scale", 6).alias("scale"))


@query(f"with {HOURLY}, {_rolling_sql(168, 72)} select record_id, h, round(centre, 6) as centre from s")
def e02_rolling_median_wide(spark, sf_dir):
    return roll.rolling_centre_and_scale(hourly(spark, sf_dir), "record_id", "h", "v", 168, 72).select("record_id", "h", F.round("centre", 6).alias("centre"))


@query(f"""with {HOURLY}, m as (select *, median(v) over (partition by record_id, h % 24) as m from hourly)
select record_id, h % 24 as hod, round(max(m), 6) as median, round(median(abs(v - m)) * 1.4826, 6) as mad, round(quantile_cont(v, 0.25), 6) as q25, round(quantile_cont(v, 0.75), 6) as q75 from m group by 1, 2""")
def e04_group_median(spark, sf_dir):
    d = roll.group_median(hourly(spark, sf_dir).withColumn("hod", detect.hour_of_day()), ["record_id", "hod"], "v", "m")
    return d.groupBy("record_id", "hod").agg(
        F.round(F.max("m"), 6).alias("median"), F.round(F.median(F.abs(F.col("v") - F.col("m"))) * 1.4826, 6).alias("mad"),
        F.round(F.percentile("v", F.lit(0.25)), 6).alias("q25"), F.round(F.percentile("v", F.lit(0.75)), 6).alias("q75"))


@query(f"""with {HOURLY}, f as (select *, n > 1 as twice, coalesce(((n > 1) <> lag(n > 1) over (partition by record_id order by h))::int, 0) ch from hourly),
r as (select *, sum(ch) over (partition by record_id order by h) run from f)
select record_id, run::bigint as run, min(h) as first_h, count(*) as hours, bool_or(twice) as twice from r group by 1, 2""")
def e05_change_islands(spark, sf_dir):
    d = seq.islands_by_change(hourly(spark, sf_dir), "record_id", "h", F.col("n") > 1)
    return d.groupBy("record_id", "run").agg(F.min("h").alias("first_h"), F.count(F.lit(1)).alias("hours"), F.bool_or(F.col("n") > 1).alias("twice"))


_ISLAND = "i as (select *, h - row_number() over (partition by record_id order by h) as run from hourly)"


@query(f"with {HOURLY}, {_ISLAND} select record_id, min(h) as first_h, max(h) as last_h, count(*) as hours from i group by record_id, run")
def e06_islands(spark, sf_dir):
    d = seq.long_islands_by_step(hourly(spark, sf_dir), "record_id", "h")
    return d.groupBy("record_id", "run").agg(F.min("h").alias("first_h"), F.max("h").alias("last_h"), F.count(F.lit(1)).alias("hours")).drop("run")


#: Hours kept of a record's longest run, as in the reference.
LIMIT = 6000
_SEGMENT = f"""{_ISLAND}, sz as (select record_id, run, count(*) len, min(h) s from i group by 1, 2),
best as (select * from (select *, row_number() over (partition by record_id order by len desc, s) rn from sz) where rn = 1),
seg as (select h.*, h.h - (b.s + (greatest(b.len - {LIMIT}, 0) // 2)) as pos, least(b.len, {LIMIT}) as seg_n from hourly h join best b using (record_id)
  where h.h between b.s + (greatest(b.len - {LIMIT}, 0) // 2) and b.s + (greatest(b.len - {LIMIT}, 0) // 2) + least(b.len, {LIMIT}) - 1)"""


def _segment(spark, sf_dir):
    return seq.longest_segment(hourly(spark, sf_dir), "record_id", "h", LIMIT)


@query(f"with {HOURLY}, {_SEGMENT} select record_id, h, pos, v from seg")
def e07_longest_segment(spark, sf_dir):
    return _segment(spark, sf_dir).select("record_id", "h", "pos", "v")


@query(f"with {monthly_sql()}, i as (select *, mo - row_number() over (partition by place, gas order by mo) run from monthly) select place, gas, min(mo) as first_mo, count(*) as months from i group by place, gas, run")
def e08_month_runs(spark, sf_dir):
    d = seq.islands_by_step(monthly(spark, sf_dir), ["place", "gas"], "mo")
    return d.groupBy("place", "gas", "run").agg(F.min("mo").alias("first_mo"), F.count(F.lit(1)).alias("months")).drop("run")


@query(f"""with {monthly_sql()}, i as (select *, mo - row_number() over (partition by place, gas order by mo) run from monthly), r as (select place, gas, min(mo) a, max(mo) b from i group by place, gas, run)
select place, gas, unnest(range(a, b - 12 + 2)) as start from r where b - a + 1 >= 12""")
def e09_blocks(spark, sf_dir):
    return seq.candidate_blocks(monthly(spark, sf_dir), ["place", "gas"], "mo", 12)


@query(f"""with {REGION}, l as (select place, gas, mean, lag(mean) over (partition by place, gas order by mo) as before from monthly)
select place, gas, round(corr(mean, before), 8) as lag1, round(median(abs(mean - before)), 4) as step from l group by 1, 2""")
def e10_lag1(spark, sf_dir):
    w = Window.partitionBy("place", "gas").orderBy("mo")
    d = monthly(spark, sf_dir, "region").withColumn("before", F.lag("mean").over(w))
    return d.groupBy("place", "gas").agg(F.round(F.corr("mean", "before"), 8).alias("lag1"), F.round(F.median(F.abs(F.col("mean") - F.col("before"))), 4).alias("step"))


_COND = """cond as (select gas, gap_hours, method, median(median_rmse) as rmse, median(median_mae) as mae, count(*) as n from gap_method_summary
  where median_rmse is not null and not isnan(median_rmse) and median_mae is not null and gas is not null and gap_hours is not null and method is not null group by 1, 2, 3)"""


def _conditions(spark, sf_dir):
    d = table(prepare(spark), sf_dir, "gap_method_summary").where("median_rmse is not null and not isnan(median_rmse) and median_mae is not null and gas is not null and gap_hours is not null and method is not null")
    return d.groupBy("gas", "gap_hours", "method").agg(F.median("median_rmse").alias("rmse"), F.median("median_mae").alias("mae"), F.count(F.lit(1)).alias("n"))


@query(f"""with {_COND} select gas, gap_hours, method, rank() over (partition by gas, gap_hours order by rmse) as rank_rmse, rank() over (partition by gas, gap_hours order by mae) as rank_mae from cond""")
def e12_rank(spark, sf_dir):
    w = Window.partitionBy("gas", "gap_hours")
    return _conditions(spark, sf_dir).select("gas", "gap_hours", "method", F.rank().over(w.orderBy("rmse")).cast("long").alias("rank_rmse"), F.rank().over(w.orderBy("mae")).cast("long").alias("rank_mae"))


@query("""with b as (select run_day, gas, gap_hours, method, median_rmse, median_rmse = min(median_rmse) over (partition by run_day, gas, gap_hours) as lowest from gap_method_summary
  where median_rmse is not null and not isnan(median_rmse) and gas is not null and run_day is not null)
select gas, gap_hours, method, count(*) as n, count(*) filter (lowest) as times_lowest, round(count(*) filter (lowest) / count(*), 9) as share from b group by 1, 2, 3""")
def e13_ties_lowest(spark, sf_dir):
    d = table(prepare(spark), sf_dir, "gap_method_summary").where("median_rmse is not null and not isnan(median_rmse) and gas is not null and run_day is not null")
    d = d.withColumn("lowest", F.col("median_rmse") == F.min("median_rmse").over(Window.partitionBy("run_day", "gas", "gap_hours")))
    return d.groupBy("gas", "gap_hours", "method").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("lowest").cast("long")).alias("times_lowest"), F.round(F.avg(F.col("lowest").cast("double")), 9).alias("share"))


@query(f"""with {_COND} select gas, method, gap_hours, round(rmse, 6) as rmse, round(rmse / nullif(first_value(rmse) over w, 0), 6) as ratio, rmse < lag(rmse) over w as decreased
from cond window w as (partition by gas, method order by gap_hours)""")
def e15_response(spark, sf_dir):
    w = Window.partitionBy("gas", "method").orderBy("gap_hours")
    first = F.first("rmse").over(w.rowsBetween(Window.unboundedPreceding, 0))
    return _conditions(spark, sf_dir).select("gas", "method", "gap_hours", F.round("rmse", 6).alias("rmse"),
                                             F.round(F.col("rmse") / F.nullif(first, F.lit(0.0)), 6).alias("ratio"), (F.col("rmse") < F.lag("rmse").over(w)).alias("decreased"))


@query(f"""with {_COND}, r as (select *, row_number() over w rn, lead(method) over w as runner_up, lead(rmse) over w - rmse as margin, rmse = min(rmse) over (partition by gas, gap_hours) as tied from cond
  window w as (partition by gas, gap_hours order by rmse, method))
select gas, gap_hours, method as winner, runner_up, round(margin, 6) as margin, (select string_agg(method, '|' order by method) from r t where t.tied and t.gas = r.gas and t.gap_hours = r.gap_hours) as ties from r where rn = 1""")
def e16_winner(spark, sf_dir):
    w = Window.partitionBy("gas", "gap_hours")
    o = w.orderBy("rmse", "method")
    d = _conditions(spark, sf_dir).withColumns({"rn": F.row_number().over(o), "runner_up": F.lead("method").over(o), "margin": F.lead("rmse").over(o) - F.col("rmse"),
                                                "ties": F.array_join(F.sort_array(F.collect_list(F.when(F.col("rmse") == F.min("rmse").over(w), F.col("method"))).over(w)), "|")})
    return d.where("rn = 1").select("gas", "gap_hours", F.col("method").alias("winner"), "runner_up", F.round("margin", 6).alias("margin"), "ties")


@query(f"""with {HOURLY}, {_SEGMENT}, hot as (select record_id, min(pos) p from (select *, v > 1.02 * median(v) over (partition by record_id) as high from seg) where high group by 1)
select s.record_id, s.pos, s.v from seg s join hot using (record_id) where s.pos >= p - 12 and s.pos < p + 13""")
def e17_context(spark, sf_dir):
    s = _segment(spark, sf_dir)
    hot = roll.group_median(s, ["record_id"], "v", "m").where(F.col("v") > 1.02 * F.col("m")).groupBy("record_id").agg(F.min("pos").alias("p"))
    return s.join(hot, "record_id").where((F.col("pos") >= F.col("p") - 12) & (F.col("pos") < F.col("p") + 13)).select("record_id", "pos", "v")


@query(f"""with {REGION}, r as (select place, gas, rank() over (partition by place, gas order by n) + (count(*) over (partition by place, gas, n) - 1) / 2.0 as rx,
  rank() over (partition by place, gas order by mean) + (count(*) over (partition by place, gas, mean) - 1) / 2.0 as ry from monthly)
select place, gas, count(*) as n, round(corr(rx, ry), 8) as rho from r group by 1, 2""")
def e18_spearman(spark, sf_dir):
    d = seq.spearman(monthly(spark, sf_dir, "region").withColumnRenamed("n", "cnt"), ["place", "gas"], "cnt", "mean")
    return d.select("place", "gas", "n", F.round("rho", 8).alias("rho"))


# G: fills. A fifth of each segment's inner hours is hidden by hash and filled again.

_HIDE = "('0x' || substr(sha256(record_id || '|' || pos::varchar), 1, 15))::bigint % 5 = 0 and pos between 5 and seg_n - 6"
_GAPS = f"{_SEGMENT}, gaps as (select *, {_HIDE} as hidden, case when {_HIDE} then null else v end as known from seg)"


def _gaps(spark, sf_dir):
    s = _segment(spark, sf_dir).withColumn("seg_n", F.count(F.lit(1)).over(Window.partitionBy("record_id")))
    hidden = (hash_draw(5, F.col("record_id"), F.col("pos").cast("string")) == 0) & F.col("pos").between(5, F.col("seg_n") - 6)
    return s.withColumn("hidden", hidden).withColumn("known", F.when(~F.col("hidden"), F.col("v"))).select("record_id", "pos", "h", "v", "hidden", "known")


_LINEAR = """lin as (select *, coalesce(known, v0 + (v1 - v0) * (pos - t0) / (t1 - t0), v0, v1) as fill from (select *,
  last_value(case when known is not null then pos end ignore nulls) over b t0, last_value(known ignore nulls) over b v0,
  first_value(case when known is not null then pos end ignore nulls) over a t1, first_value(known ignore nulls) over a v1 from gaps
  window b as (partition by record_id order by pos rows between unbounded preceding and 1 preceding), a as (partition by record_id order by pos rows between 1 following and unbounded following)))"""


@query(f"with {HOURLY}, {_GAPS}, {_LINEAR} select record_id, pos, round(fill, 6) as fill from lin where hidden")
def g01_linear(spark, sf_dir):
    return fill.linear(_gaps(spark, sf_dir), ["record_id"], "pos", "known").where("hidden").select("record_id", "pos", F.round("fill", 6).alias("fill"))


@query(f"""with {HOURLY}, {_GAPS}, k as (select record_id, pos, {{'t': pos, 'v': known, 'ta': lag(pos) over w, 'va': lag(known) over w, 'tb': lead(pos) over w, 'vb': lead(known) over w}} as p
  from gaps where known is not null window w as (partition by record_id order by pos)),
j as (select g.*, last_value(p ignore nulls) over (partition by g.record_id order by g.pos rows between unbounded preceding and 1 preceding) l,
  first_value(p ignore nulls) over (partition by g.record_id order by g.pos rows between 1 following and unbounded following) r from gaps g left join k using (record_id, pos)),
q as (select *, (r.t - l.t)::double hh, (l.t - l.ta)::double ha, (r.tb - r.t)::double hb, (r.v - l.v) / (r.t - l.t) d, (l.v - l.va) / (l.t - l.ta) sa, (r.vb - r.v) / (r.tb - r.t) sb, (pos - l.t) / (r.t - l.t)::double s from j where hidden),
m as (select *, case when sa * d <= 0 then 0.0 else ((2 * hh + ha) + (hh + 2 * ha)) / ((2 * hh + ha) / sa + (hh + 2 * ha) / d) end m0,
  case when d * sb <= 0 then 0.0 else ((2 * hb + hh) + (hb + 2 * hh)) / ((2 * hb + hh) / d + (hb + 2 * hh) / sb) end m1 from q)
select record_id, pos, round((1 + 2 * s) * (1 - s) * (1 - s) * l.v + s * (1 - s) * (1 - s) * hh * m0 + s * s * (3 - 2 * s) * r.v + s * s * (s - 1) * hh * m1, 6) as fill from m""")
def g02_pchip(spark, sf_dir):
    return fill.pchip(_gaps(spark, sf_dir), ["record_id"], "pos", "known").where("hidden").select("record_id", "pos", F.round("fill", 6).alias("fill"))


@query()
def g03_kalman(spark, sf_dir):
    g = _gaps(spark, sf_dir)
    return fill.local_level_kalman(g, ["record_id"], "pos", "known").join(g.where("hidden").select("record_id", "pos"), ["record_id", "pos"]).select("record_id", "pos", F.round("fill", 5).alias("fill"))


@query(f"""with {HOURLY}, {_GAPS}, m as (select record_id, h % 24 as hod, median(known) as m from gaps group by 1, 2)
select g.record_id, g.pos, round(m.m, 6) as fill from gaps g join m on m.record_id = g.record_id and m.hod = g.h % 24 where hidden""")
def g04_seasonal(spark, sf_dir):
    g = _gaps(spark, sf_dir).withColumn("hod", detect.hour_of_day())
    return fill.seasonal_median(g, ["record_id"], "hod", "known").where("hidden").select("record_id", "pos", F.round("fill", 6).alias("fill"))


@query(f"""with {HOURLY}, {_GAPS.replace('gaps as', 'gaps0 as')}, m as (select record_id, h % 24 as hod, median(known) as m from gaps0 group by 1, 2),
gaps as (select g.record_id, g.pos, g.hidden, m.m, g.known - m.m as known from gaps0 g join m on m.record_id = g.record_id and m.hod = g.h % 24), {_LINEAR}
select record_id, pos, round(m + fill, 6) as fill from lin where hidden""")
def g05_residual_linear(spark, sf_dir):
    g = _gaps(spark, sf_dir).withColumn("hod", detect.hour_of_day())
    return fill.seasonal_residual_linear(g, ["record_id"], "pos", "hod", "known").where("hidden").select("record_id", "pos", F.round("fill", 6).alias("fill"))


_ONE = """one as (select record_id, h, v, false as filled from hourly union all select record_id, h - 1, (v + pv) / 2, true
  from (select *, lag(h) over w ph, lag(v) over w pv from hourly window w as (partition by record_id order by h)) where h - ph = 2)"""


@query(f"with {HOURLY}, {_ONE} select record_id, h, round(v, 6) as v from one where filled")
def g06_one_hour(spark, sf_dir):
    return fill.one_hour_fill(hourly(spark, sf_dir), "record_id", "h", "v").where("filled").select("record_id", "h", F.round("v", 6).alias("v"))


@query(f"""with {HOURLY}, {_ONE} select record_id, h // 24 as day, round(avg(v) filter (not filled) + 1.2345e-9, 6) as observed, round(avg(v) + 1.2345e-9, 6) as reconstructed, count(*) filter (filled) as fills from one group by 1, 2""")
def g07_resample(spark, sf_dir):
    d = fill.one_hour_fill(hourly(spark, sf_dir), "record_id", "h", "v")
    return d.groupBy("record_id", F.floor(F.col("h") / 24).cast("long").alias("day")).agg(
        F.round(F.avg(F.when(~F.col("filled"), F.col("v"))) + 1.2345e-9, 6).alias("observed"), F.round(F.avg("v") + 1.2345e-9, 6).alias("reconstructed"), F.sum(F.col("filled").cast("long")).alias("fills"))


@query(f"""with {HOURLY}, {_GAPS}, {_LINEAR}, e as (select *, fill - v as e from lin where hidden)
select record_id, count(*) as n, round(avg(abs(e)), 5) as mae, round(sqrt(avg(e * e)), 5) as rmse, round(avg(e), 5) as bias, round(max(abs(e)), 5) as max_abs, round(avg(fill) - avg(v), 5) as mean_shift from e group by 1""")
def d24_gap_metrics(spark, sf_dir):
    d = fill.linear(_gaps(spark, sf_dir), ["record_id"], "pos", "known").where("hidden")
    m = fill.gap_metrics(d, ["record_id"], "v", "fill")
    return m.select("record_id", "n", *[F.round(c, 5).alias(c) for c in ("mae", "rmse", "bias", "max_abs", "mean_shift")])


@query()
def j13_gap_evaluation(spark, sf_dir):
    """All five fills of each of j11's gaps, judged per gap and method. Only one gap is hidden at a time."""
    seg = cut(_segment(spark, sf_dir))
    gaps = cut(_placements(seg))
    inside = (F.col("pos") >= F.col("start")) & (F.col("pos") < F.col("start") + F.col("gap_hours"))
    g = cut(seg.join(gaps.select("record_id", "gap_id", "start", "gap_hours"), "record_id").withColumn("hidden", inside)
            .select("gap_id", "pos", "v", "hidden", F.when(~F.col("hidden"), F.col("v")).alias("known"), detect.hour_of_day().alias("hod")))
    key = ["gap_id"]
    made = {
        "linear": fill.linear(g, key, "pos", "known"), "pchip": fill.pchip(g, key, "pos", "known"),
        "local_level_kalman": fill.local_level_kalman(g, key, "pos", "known").drop("known").join(g.where("hidden"), ["gap_id", "pos"]),
        "seasonal_median": fill.seasonal_median(g, key, "hod", "known"), "seasonal_residual_linear": fill.seasonal_residual_linear(g, key, "pos", "hod", "known"),
    }
    out = None
    for name, d in made.items():
        part = d.where("hidden and fill is not null").select(F.lit(name).alias("method"), "gap_id", "v", "fill")
        out = part if out is None else out.unionByName(part)
    m = fill.gap_metrics(out, ["method", "gap_id"], "v", "fill").join(gaps, "gap_id")
    return m.select("method", "gap_id", "record_id", "season", "gap_hours", "placement", "role", "n", *[F.round(c, 5).alias(c) for c in ("mae", "rmse", "bias", "max_abs", "corr", "mean_shift")])


# H: detectors and trends

_HOD = "partition by record_id, h % 24"


@query(f"""with {HOURLY}, a as (select *, v - median(v) over ({_HOD}) r from hourly), b as (select *, abs(r - median(r) over ({_HOD})) as dev from a), c as (select *, median(dev) over ({_HOD}) s from b)
select record_id, h from c where abs(r) > 3 * greatest(1.4826 * s, 1e-9)""")
def h10_seasonal_mad(spark, sf_dir):
    return detect.flags(hourly(spark, sf_dir), "record_id", "h", "v", "seasonal_mad", 3.0).where("flag").select("record_id", "h")


@query(f"""with {HOURLY}, r as (select record_id, h, v - median(v) over ({_HOD}) as r from hourly), {_rolling_sql(168, 72, 'r', 'r')}
select record_id, h from s where abs(r - centre) > 3 * greatest(1.4826 * scale, 1e-9)""")
def h11_rolling_seasonal_mad(spark, sf_dir):
    return detect.flags(hourly(spark, sf_dir), "record_id", "h", "v", "rolling_seasonal_mad", 3.0).where("flag").select("record_id", "h")


@query(f"with {HOURLY}, {_rolling_sql(84, 48)} select record_id, h from s where abs(v - centre) > 3 * greatest(1.4826 * scale, 1e-9)")
def h12_hampel(spark, sf_dir):
    return detect.flags(hourly(spark, sf_dir), "record_id", "h", "v", "hampel_7day", 3.0).where("flag").select("record_id", "h")


@query(f"""with {HOURLY}, q as (select *, quantile_cont(v, 0.25) over ({_HOD}) a, quantile_cont(v, 0.75) over ({_HOD}) b from hourly)
select record_id, h from q where v < a - 3 * 0.5 * (b - a) - 1e-9 or v > b + 3 * 0.5 * (b - a) + 1e-9""")
def h13_iqr_hour(spark, sf_dir):
    return detect.flags(hourly(spark, sf_dir), "record_id", "h", "v", "iqr_hour", 3.0).where("flag").select("record_id", "h")


def _review(spark, sf_dir):
    """Hampel flags against the provider's own verdict, hour by hour; an hour without a number has no flag."""
    h = cut(judged_hours(spark, sf_dir))
    found = detect.hampel(h.where("v is not null"), "record_id", "h", "v", 3.0).select("record_id", "h", "flag")
    return h.join(found, ["record_id", "h"], "left").withColumn("flag", F.coalesce("flag", F.lit(False)))


_REVIEW = f"""{JUDGED}, jn as (select record_id, h, v from judged where v is not null), {_rolling_sql(84, 48, "v", "jn")},
rev as (select j.record_id, j.h, coalesce(abs(s.v - centre) > 3 * greatest(1.4826 * scale, 1e-9), false) as flag, truth from judged j left join s using (record_id, h))"""
_COUNTS = "count(*) filter (flag and truth) as tp, count(*) filter (flag and not truth) as fp, count(*) filter (not flag and truth) as fn, count(*) filter (not flag and not truth) as tn"


@query(f"""with {_REVIEW}, cnt as (select record_id, {_COUNTS} from rev group by 1), p as (select *, case when tp + fp > 0 then tp / (tp + fp) else 0 end pr, case when tp + fn > 0 then tp / (tp + fn) else 0 end rc, case when fp + tn > 0 then fp / (fp + tn) else 0 end fr from cnt)
select record_id, tp, fp, fn, tn, round(pr, 9) as prec, round(rc, 9) as recall, round(fr, 9) as fpr, round(case when pr + rc > 0 then 2 * pr * rc / (pr + rc) else 0 end, 9) as f1 from p""")
def d16_metrics(spark, sf_dir):
    d = detect.rates(_review(spark, sf_dir).groupBy("record_id").agg(*detect.confusion(F.col("flag"), F.col("truth"))))
    return d.select("record_id", "tp", "fp", "fn", "tn", *[F.round(c, 9).alias(c) for c in ("prec", "recall", "fpr", "f1")])


@query(f"""with {_REVIEW} select record_id, count(*) filter (flag and truth) as both, count(*) filter (flag <> truth) as differing, round(count(*) filter (flag) / count(*), 9) as flag_share,
  sum(('0x' || substr(sha256(h::varchar || case when flag then '|1' else '|0' end), 1, 10))::bigint)::bigint as mask from rev group by 1""")
def d21_review_flags(spark, sf_dir):
    d = _review(spark, sf_dir)
    return d.groupBy("record_id").agg(
        F.sum((F.col("flag") & F.col("truth")).cast("long")).alias("both"), F.sum((F.col("flag") != F.col("truth")).cast("long")).alias("differing"),
        F.round(F.avg(F.col("flag").cast("double")), 9).alias("flag_share"),
        # the hours' hashes add up to the mask's, so no task holds a record's hours
        F.sum(F.conv(F.substring(F.sha2(F.concat(F.col("h").cast("string"), F.when(F.col("flag"), "|1").otherwise("|0")), 256), 1, 10), 16, 10).cast("long")).alias("mask"))


_PAIRS = """pr as (select a.place, a.gas, a.mo as m0, b.mo as m1, b.mean - a.mean as dy, (b.mo - a.mo) / 12.0::double as dx from monthly a join monthly b on a.place = b.place and a.gas = b.gas and a.mo < b.mo {same})"""
_ALL, _SAME = _PAIRS.format(same=""), _PAIRS.format(same="and a.mo % 12 = b.mo % 12")


@query(f"with {REGION}, {_ALL} select place, gas, round(median(dy / dx), 4) as slope, count(*) as n_pairs from pr group by 1, 2")
def h01_theil_sen(spark, sf_dir):
    d = trend.sen_slope(monthly(spark, sf_dir, "region"), ["place", "gas"], "mo", "mean")
    return d.select("place", "gas", F.round("slope", 4).alias("slope"), "n_pairs")


@query(f"""with {REGION}, {_ALL}, n as (select place, gas, count(*)::double n from monthly group by 1, 2), t as (select place, gas, sum(c * (c - 1) * (2 * c + 5)) ties from (select place, gas, mean, count(*)::double c from monthly group by 1, 2, 3) group by 1, 2),
r as (select place, gas, dy / dx s, row_number() over (partition by place, gas order by dy / dx) - 1 r, count(*) over (partition by place, gas) np from pr),
b as (select r.*, greatest(round_even((np - 1.959963984540054 * sqrt((n * (n - 1) * (2 * n + 5) - ties) / 18)) / 2, 0) - 1, 0) lo, least(round_even((np + 1.959963984540054 * sqrt((n * (n - 1) * (2 * n + 5) - ties) / 18)) / 2, 0), np - 1) hi from r join n using (place, gas) join t using (place, gas))
select place, gas, round(median(s), 4) as slope, round(max(s) filter (r = lo), 4) as low, round(max(s) filter (r = hi), 4) as high from b group by 1, 2""")
def h03_sen_interval(spark, sf_dir):
    d = trend.sen_interval(monthly(spark, sf_dir, "region"), ["place", "gas"], "mo", "mean")
    return d.select("place", "gas", *[F.round(c, 4).alias(c) for c in ("slope", "low", "high")])


@query(f"""with {REGION} select place, gas, round(regr_slope(mean, mo // 12 + (mo % 12 + 0.5) / 12), 3) as ols, round(corr(mean, mo // 12 + (mo % 12 + 0.5) / 12), 7) as r, count(*) as n from monthly group by 1, 2""")
def h04_ols(spark, sf_dir):
    d = trend.ols_slope(monthly(spark, sf_dir, "region"), ["place", "gas"], "mo", "mean")
    return d.select("place", "gas", F.round("ols", 3).alias("ols"), F.round("r", 7).alias("r"), "n")


@query(f"""with {REGION}, {_SAME}, k as (select place, gas, sum(sign(dy)) as s, count(*) as n_pairs from pr group by 1, 2)
select place, gas, s::double as s, n_pairs, round(case when n_pairs < 10 then null when s = 0 then 0 else (s - sign(s)) / sqrt(n_pairs / 3.0::double) end, 8) as z from k""")
def h05_kendall(spark, sf_dir):
    d = trend.seasonal_kendall(monthly(spark, sf_dir, "region"), ["place", "gas"], "mo", "mean")
    return d.select("place", "gas", "s", "n_pairs", F.round("z", 8).alias("z"))


@query()
def h05_kendall_p(spark, sf_dir):
    d = trend.seasonal_kendall(monthly(spark, sf_dir, "region"), ["place", "gas"], "mo", "mean")
    return d.select("place", "gas", trend.two_sided_p("z").alias("p"))


@query(f"with {REGION}, {_SAME} select place, gas, round(median(dy / dx), 4) as slope from pr group by 1, 2")
def h06_seasonal_sen(spark, sf_dir):
    return trend.sen_slope(monthly(spark, sf_dir, "region"), ["place", "gas"], "mo", "mean", True).select("place", "gas", F.round("slope", 4).alias("slope"))


_DECOMP = f"""{_SAME}, sl as (select place, gas, median(dy / dx) slope from pr group by 1, 2), f as (select place, gas, min(mo) m0 from monthly group by 1, 2),
d as (select m.place, m.gas, m.mo, m.mean, slope * ((m.mo - m0) / 12.0::double) as rise, m.mean - slope * ((m.mo - m0) / 12.0::double) as flat from monthly m join sl using (place, gas) join f using (place, gas)),
mm as (select place, gas, mo % 12 cm, median(flat) mm from d group by 1, 2, 3), e as (select d.*, mm.mm from d join mm on mm.place = d.place and mm.gas = d.gas and mm.cm = d.mo % 12),
c as (select place, gas, avg(mm) centre from e group by 1, 2), dec as (select place, gas, mo, mean, centre + rise as fitted, mm - centre as seasonal, mean - (centre + rise) - (mm - centre) as residual from e join c using (place, gas))"""


@query(f"with {REGION}, {_DECOMP} select place, gas, mo, round(fitted + 1.2345e-7, 4) as fitted, round(seasonal + 1.2345e-7, 4) as seasonal, round(residual + 1.2345e-7, 4) as residual from dec")
def h08_decomposition(spark, sf_dir):
    d = trend.decompose(monthly(spark, sf_dir, "region"), ["place", "gas"], "mo", "mean")
    return d.select("place", "gas", "mo", *[F.round(F.col(c) + 1.2345e-7, 4).alias(c) for c in ("fitted", "seasonal", "residual")])  # off the ties of rounding


_CLIM = "cl as (select place, gas, mo % 12 as cm, avg(mean) as clim from monthly group by 1, 2, 3)"


@query(f"with {REGION}, {_CLIM} select place, gas, cm, round(clim, 4) as clim from cl")
def d09_climatology(spark, sf_dir):
    return trend.climatology(monthly(spark, sf_dir, "region"), ["place", "gas"], "mo", "mean").select("place", "gas", "cm", F.round("clim", 4).alias("clim"))


@query(f"""with {REGION}, {_CLIM} select place, gas, round(case when count(*) >= 8 then max(clim) - min(clim) end, 4) as amplitude,
  arg_min(cm, (-clim, cm)) as max_month, arg_min(cm, (clim, cm)) as min_month from cl group by 1, 2""")
def d10_amplitude(spark, sf_dir):
    return trend.amplitude(monthly(spark, sf_dir, "region"), ["place", "gas"], "mo", "mean").select("place", "gas", F.round("amplitude", 4).alias("amplitude"), "max_month", "min_month")


@query(f"""with {REGION}, y as (select place, gas, mo // 12 as yr, case when count(distinct mo % 12) >= 8 then max(mean) - min(mean) end as a from monthly group by 1, 2, 3)
select place, gas, round(stddev_samp(a), 4) as sd from y group by 1, 2""")
def d11_interannual_sd(spark, sf_dir):
    d = monthly(spark, sf_dir, "region")
    y = d.groupBy("place", "gas", F.floor(F.col("mo") / 12).alias("yr")).agg(F.when(F.countDistinct(F.col("mo") % 12) >= 8, F.max("mean") - F.min("mean")).alias("a"))
    return y.groupBy("place", "gas").agg(F.round(F.stddev("a"), 4).alias("sd"))


@query(f"""with {HOURLY}, m as (select record_id, median(v) m from hourly group by 1) select record_id, round(1.4826 * median(abs(v - m)), 6) as mad from hourly join m using (record_id) group by 1""")
def d15_mad(spark, sf_dir):
    return roll.mad(hourly(spark, sf_dir), ["record_id"], "v").select("record_id", F.round("mad", 6).alias("mad"))


@query(f"""with {HOURLY}, c as (select record_id, h % 24 hod, avg(v) a from hourly group by 1, 2) select record_id, round(max(a) - min(a), 4) as diurnal from c group by 1""")
def h18_diurnal(spark, sf_dir):
    c = hourly(spark, sf_dir).groupBy("record_id", detect.hour_of_day().alias("hod")).agg(F.avg("v").alias("a"))
    return c.groupBy("record_id").agg(F.round(F.max("a") - F.min("a"), 4).alias("diurnal"))


@query(f"""with {REGION}, z as (select place, gas, mo, (mean - avg(mean) over w) / stddev_samp(mean) over w as z from monthly window w as (partition by place, gas))
select a.place, count(*) as months, round(corr(a.z, b.z), 7) as r from z a join z b on a.place = b.place and a.mo = b.mo and a.gas = 'F' and b.gas = 'O' group by 1 having count(*) >= 12""")
def h15_paired(spark, sf_dir):
    w = Window.partitionBy("place", "gas")
    z = monthly(spark, sf_dir, "region").withColumn("z", (F.col("mean") - F.avg("mean").over(w)) / F.stddev("mean").over(w))
    a = z.where("gas = 'F'").select("place", "mo", F.col("z").alias("za"))
    b = z.where("gas = 'O'").select("place", "mo", F.col("z").alias("zb"))
    d = a.join(b, ["place", "mo"]).groupBy("place").agg(F.count(F.lit(1)).alias("months"), F.round(F.corr("za", "zb"), 7).alias("r"))
    return d.where("months >= 12")


@query(f"""with {REGION}, p as (select place, gas, mo, mean, 'LONGEST' as period from monthly union all select place, gas, mo, mean, 'COMMON' from monthly where mo >= 1997 * 12 and mo < 2001 * 12),
s as (select a.place, a.gas, a.period, median((b.mean - a.mean) / ((b.mo - a.mo) / 12.0::double)) as slope from p a join p b on a.place = b.place and a.gas = b.gas and a.period = b.period and a.mo < b.mo group by 1, 2, 3)
select place, gas, round(max(slope) filter (period = 'LONGEST'), 4) as longest, round(max(slope) filter (period = 'COMMON'), 4) as common, round(max(slope) filter (period = 'COMMON') - max(slope) filter (period = 'LONGEST'), 4) as difference from s group by 1, 2""")
def h16_periods(spark, sf_dir):
    m = monthly(spark, sf_dir, "region").select("place", "gas", "mo", "mean")
    p = m.withColumn("period", F.lit("LONGEST")).unionByName(m.where((F.col("mo") >= 1997 * 12) & (F.col("mo") < 2001 * 12)).withColumn("period", F.lit("COMMON")))
    s = trend.sen_slope(p, ["place", "gas", "period"], "mo", "mean")
    wide = s.groupBy("place", "gas").pivot("period", ["LONGEST", "COMMON"]).agg(F.first("slope"))
    return wide.select("place", "gas", F.round("LONGEST", 4).alias("longest"), F.round("COMMON", 4).alias("common"), F.round(F.col("COMMON") - F.col("LONGEST"), 4).alias("difference"))


@query(f"with {REGION}, {_CLIM} select place, gas, " + ", ".join(f"round(max(clim) filter (cm = {m}), 4) as m{m + 1:02d}" for m in range(12)) + " from cl group by 1, 2")
def h17_seasonal(spark, sf_dir):
    c = trend.climatology(monthly(spark, sf_dir, "region"), ["place", "gas"], "mo", "mean")
    wide = c.groupBy("place", "gas").pivot("cm", list(range(12))).agg(F.max("clim"))
    return wide.select("place", "gas", *[F.round(str(m), 4).alias(f"m{m + 1:02d}") for m in range(12)])


@query(f"""with {REGION} select mo, gas, round(median(mean), 4) as cross_median, count(*) as places from monthly group by 1, 2""")
def k10_cross_median(spark, sf_dir):
    return monthly(spark, sf_dir, "region").groupBy("mo", "gas").agg(F.round(F.median("mean"), 4).alias("cross_median"), F.count(F.lit(1)).alias("places"))


# D25 to D31: summaries of method tests

_OK = "median_rmse is not null and not isnan(median_rmse) and gas is not null and gap_hours is not null and method is not null"


@query(f"""with s as (select gas, gap_hours, method, physical_stations, median(median_rmse) m from gap_method_summary where {_OK} and physical_stations is not null group by 1, 2, 3, 4)
select gas, gap_hours, method, count(*) as strata, round(median(m), 10) as median_rmse, round(min(m), 10) as lowest, round(max(m), 10) as highest, round(quantile_cont(m, 0.25), 10) as q25, round(quantile_cont(m, 0.75), 10) as q75 from s group by 1, 2, 3""")
def d25_median_of_medians(spark, sf_dir):
    s = table(prepare(spark), sf_dir, "gap_method_summary").where(_OK + " and physical_stations is not null").groupBy("gas", "gap_hours", "method", "physical_stations").agg(F.median("median_rmse").alias("m"))
    r = lambda c, n: F.round(c, 10).alias(n)
    return s.groupBy("gas", "gap_hours", "method").agg(F.count(F.lit(1)).alias("strata"), r(F.median("m"), "median_rmse"), r(F.min("m"), "lowest"), r(F.max("m"), "highest"),
                                                       r(F.percentile("m", F.lit(0.25)), "q25"), r(F.percentile("m", F.lit(0.75)), "q75"))


_DAY = f"day as (select run_day, gas, gap_hours, method, round(median(median_rmse), 9) as m from gap_method_summary where {_OK} and run_day is not null group by 1, 2, 3, 4)"


def _daily(spark, sf_dir):
    d = table(prepare(spark), sf_dir, "gap_method_summary").where(_OK + " and run_day is not null")
    return d.groupBy("run_day", "gas", "gap_hours", "method").agg(F.round(F.median("median_rmse"), 9).alias("m"))


@query(f"""with {_DAY} select a.gas, a.gap_hours, a.method as method_a, b.method as method_b, count(*) as days, round(median(a.m - b.m), 11) as median_delta, round(avg((a.m < b.m)::int), 9) as share_a_better, count(*) filter (a.m = b.m) as ties
from day a join day b on a.run_day = b.run_day and a.gas = b.gas and a.gap_hours = b.gap_hours and a.method < b.method group by 1, 2, 3, 4""")
def c05_paired_methods(spark, sf_dir):
    d = _daily(spark, sf_dir)
    a, b = d.withColumnsRenamed({"method": "method_a", "m": "ma"}), d.withColumnsRenamed({"method": "method_b", "m": "mb"})
    p = a.join(b, ["run_day", "gas", "gap_hours"]).where("method_a < method_b")
    return p.groupBy("gas", "gap_hours", "method_a", "method_b").agg(
        F.count(F.lit(1)).alias("days"), F.round(F.median(F.col("ma") - F.col("mb")), 11).alias("median_delta"), F.round(F.avg((F.col("ma") < F.col("mb")).cast("double")), 9).alias("share_a_better"),
        F.sum((F.col("ma") == F.col("mb")).cast("long")).alias("ties"))


@query(f"""with {_DAY}, n as (select *, count(distinct method) over (partition by run_day, gas, gap_hours) k from day)
select gas, gap_hours, count(distinct run_day) as days, count(distinct run_day) filter (k = 5) as complete_days from n group by 1, 2""")
def d31_complete(spark, sf_dir):
    d = _daily(spark, sf_dir)
    k = d.groupBy("run_day", "gas", "gap_hours").agg(F.countDistinct("method").alias("k"))
    return k.groupBy("gas", "gap_hours").agg(F.count(F.lit(1)).alias("days"), F.sum((F.col("k") == 5).cast("long")).alias("complete_days"))


@query(f"""with {_DAY} select gas, run_day::varchar as run_day, gap_hours, """ + ", ".join(f"round(max(m) filter (method = '{m}'), 6) as {m}" for m in fill.METHODS) + " from day group by 1, 2, 3")
def i04_pivot_methods(spark, sf_dir):
    wide = _daily(spark, sf_dir).groupBy("gas", "run_day", "gap_hours").pivot("method", list(fill.METHODS)).agg(F.max("m"))
    return wide.select("gas", F.col("run_day").cast("string").alias("run_day"), "gap_hours", *[F.round(m, 6).alias(m) for m in fill.METHODS])


@query(f"""with r as (select gas, physical_stations st, method, median_rmse x from gap_method_summary where {_OK} and physical_stations is not null),
a as (select gas, st, method, avg(x) x from r group by 1, 2, 3), b as (select gas, method, avg(x) x from a group by 1, 2) select method, round(avg(x), 6) as mean_of_means from b group by 1""")
def d17_hierarchy(spark, sf_dir):
    d = table(prepare(spark), sf_dir, "gap_method_summary").where(_OK + " and physical_stations is not null")
    a = d.groupBy("gas", "physical_stations", "method").agg(F.avg("median_rmse").alias("x"))
    b = a.groupBy("gas", "method").agg(F.avg("x").alias("x"))
    return b.groupBy("method").agg(F.round(F.avg("x"), 6).alias("mean_of_means"))


def _scores(spark, sf_dir):
    """Detector results per configuration and record: every detector at k = 3, 4, 5 against the provider's verdict, over all hours with a number."""
    h = cut(judged_hours(spark, sf_dir).where("v is not null"))
    out = None
    for method in detect.METHODS:
        d = detect.flags_each(h, "record_id", "h", "v", method, detect.KS).join(h.select("record_id", "h", "truth"), ["record_id", "h"])
        d = detect.rates(d.groupBy("record_id", "k").agg(*detect.confusion(F.col("flag"), F.col("truth"))))
        d = d.select(F.concat(F.lit(f"{method} k="), F.col("k").cast("int").cast("string")).alias("configuration"), "record_id", "f1", "fpr", "recall", "prec", "tp", "fp", "fn", "tn")
        out = d if out is None else out.unionByName(d)
    return cut(out)


def _score_sql() -> str:
    parts = []
    for k in (3, 4, 5):
        parts += [f"select 'seasonal_mad k={k}' as configuration, record_id, h, truth, abs(r) > {k} * greatest(1.4826 * s, 1e-9) as flag from c3",
                  f"select 'iqr_hour k={k}', record_id, h, truth, v < qa - {k} * 0.5 * (qb - qa) - 1e-9 or v > qb + {k} * 0.5 * (qb - qa) + 1e-9 from q3",
                  f"select 'hampel_7day k={k}', record_id, h, truth, coalesce(abs(v - centre) > {k} * greatest(1.4826 * scale, 1e-9), false) from hs",
                  f"select 'rolling_seasonal_mad k={k}', record_id, h, truth, coalesce(abs(r - centre) > {k} * greatest(1.4826 * scale, 1e-9), false) from rs"]
    roll = lambda name, half, least, x, source: _rolling_sql(half, least, x, source).replace("c as (", f"{name}c as (", 1).replace("\ns as (", f"\n{name}s as (", 1).replace("from c)", f"from {name}c)")
    return f"""{JUDGED}, jn as (select * from judged where v is not null),
a3 as (select *, v - median(v) over ({_HOD}) r from jn), b3 as (select *, abs(r - median(r) over ({_HOD})) as dev from a3), c3 as (select *, median(dev) over ({_HOD}) s from b3),
q3 as (select *, quantile_cont(v, 0.25) over ({_HOD}) qa, quantile_cont(v, 0.75) over ({_HOD}) qb from jn), {roll("h", 84, 48, "v", "jn")}, {roll("r", 168, 72, "r", "a3")},
fl as ({' union all '.join(parts)}), cf as (select configuration, record_id, {_COUNTS} from fl group by 1, 2),
pr3 as (select *, case when tp + fp > 0 then tp / (tp + fp) else 0 end as prec, case when tp + fn > 0 then tp / (tp + fn) else 0 end as recall, case when fp + tn > 0 then fp / (fp + tn) else 0 end as fpr from cf),
sc as (select *, case when prec + recall > 0 then 2 * prec * recall / (prec + recall) else 0 end as f1 from pr3)"""


#: Scores this near to the best count as ties, as in the reference.
TOL = 1e-12
RULES = [("f1", "max"), ("fpr", "min"), ("recall", "max"), ("prec", "max")]
_M = "round(avg(f1), 9) f1, round(avg(fpr), 9) fpr, round(avg(recall), 9) recall, round(avg(prec), 9) prec"


def _lexi_sql(source: str, key: str, last: str) -> str:
    steps, prev = [], source
    for i, (c, b) in enumerate(RULES):
        f = "max" if b == "max" else "min"
        steps.append(f"{last}{i} as (select * exclude (edge) from (select *, {f}({c}) over (partition by {key}) as edge from {prev}) where abs({c} - edge) <= {TOL})")
        prev = f"{last}{i}"
    steps.append(f"{last} as (select * from (select *, row_number() over (partition by {key} order by configuration) rn from {prev}) where rn = 1)")
    return ", ".join(steps)


@query(f"with {_score_sql()}, {_lexi_sql('sc', 'record_id', 'best')} select record_id, configuration from best")
def f05_lexicographic(spark, sf_dir):
    return seq.pick_with_tolerance(_scores(spark, sf_dir), ["record_id"], RULES, "configuration", TOL).select("record_id", "configuration")


@query(f"""with {_score_sql()}, st as (select *, substr(record_id, 1, 4) as station from sc), per as (select station, configuration, {_M} from st group by 1, 2),
folds as (select distinct station as fold from st), train as (select fold, configuration, {_M} from folds join per on station <> fold group by 1, 2), {_lexi_sql('train', 'fold', 'best')}
select fold, best.configuration, per.f1, per.fpr from best join per on per.station = best.fold and per.configuration = best.configuration""")
def d19_leave_one_out(spark, sf_dir):
    m = [F.round(F.avg(c), 9).alias(c) for c in ("f1", "fpr", "recall", "prec")]
    per = cut(_scores(spark, sf_dir).groupBy(F.substring("record_id", 1, 4).alias("station"), "configuration").agg(*m))
    folds = per.select(F.col("station").alias("fold")).distinct()
    train = folds.join(per, F.col("station") != F.col("fold")).groupBy("fold", "configuration").agg(*m)
    best = seq.pick_with_tolerance(train, ["fold"], RULES, "configuration", TOL).select("fold", "configuration")
    held = per.select(F.col("station").alias("fold"), "configuration", "f1", "fpr")
    return best.join(held, ["fold", "configuration"])


@query(f"""with {_score_sql()}, m as (select configuration, split_part(configuration, ' ', 1) as method, split_part(configuration, 'k=', 2)::int as k, round(avg(f1), 9) as f1 from sc group by 1),
b as (select * from (select *, row_number() over (partition by method order by f1 desc, k) rn from m) where rn = 1)
select record_id, method, k, tp, fp, fn, tn, tp + fp as flagged from cf join b using (configuration)""")
def d22_baseline_agreement(spark, sf_dir):
    """Each detector at its best k against the provider's verdict, per record."""
    sc = _scores(spark, sf_dir).withColumns({"method": F.substring_index("configuration", " ", 1), "k": F.substring_index("configuration", "k=", -1).cast("int")})
    best = seq.top_rows(sc.groupBy("method", "k").agg(F.round(F.avg("f1"), 9).alias("f1")), ["method"], [F.desc("f1"), "k"], 1).select("method", "k")
    return sc.join(best, ["method", "k"]).select("record_id", "method", "k", "tp", "fp", "fn", "tn", (F.col("tp") + F.col("fp")).alias("flagged"))


@query(f"""with {_score_sql()}, f as (select substr(record_id, 1, 4) as fold, count(distinct record_id) as records from sc group by 1) select fold, records, (sum(records) over () - records)::bigint as training_records from f""")
def c14_fold_counts(spark, sf_dir):
    """Records of each held-out station and of its training set."""
    f = judged_hours(spark, sf_dir).where("v is not null").groupBy(F.substring("record_id", 1, 4).alias("fold")).agg(F.countDistinct("record_id").alias("records"))
    total = f.agg(F.sum("records").alias("total"))
    return f.crossJoin(F.broadcast(total)).select("fold", "records", (F.col("total") - F.col("records")).alias("training_records"))  # one row beside the folds


@query(f"""with {REGION}, {_ALL}, t as (select place, gas, median(dy / dx) as slope from pr group by 1, 2 having count(*) >= 3000), cl as (select place, gas, mo % 12 as cm, avg(mean) as clim from monthly group by 1, 2, 3),
a as (select place, gas, max(clim) - min(clim) as amplitude from cl group by 1, 2 having count(*) >= 8), p as (select place, gas, sum(n)::bigint as n, count(*) as months from monthly group by 1, 2)
select p.place, p.gas, p.n, p.months, round(slope, 4) as slope, round(amplitude, 4) as amplitude from p left join t using (place, gas) left join a using (place, gas)""")
def c02_trend_seasonal_product(spark, sf_dir):
    """Products with their trend (of 3000 pairs of months or more) and seasonal amplitude, where they have one."""
    m = cut(monthly(spark, sf_dir, "region"))
    p = m.groupBy("place", "gas").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("months"))
    t = trend.sen_slope(m, ["place", "gas"], "mo", "mean").where("n_pairs >= 3000").select("place", "gas", F.round("slope", 4).alias("slope"))
    a = trend.amplitude(m, ["place", "gas"], "mo", "mean").select("place", "gas", F.round("amplitude", 4).alias("amplitude"))
    return p.join(t, ["place", "gas"], "left").join(a, ["place", "gas"], "left")


# J: resampling, with the reference's replicates.

REPETITIONS = 20
BLOCKS = STATIONS = 5000
TRENDS = COHORTS = RANKS = 2000

_BOOT = f"""members as (select gas, method, row_number() over (partition by gas, method order by gap_hours) - 1 as draw, rmse as x, count(*) over (partition by gas, method) as size from cond),
draws as (select gas, method, rep, slot, ('0x' || substr(sha256('block|' || gas || '|' || method || '|' || rep::varchar || '|' || slot::varchar), 1, 15))::bigint % size as draw
  from (select distinct gas, method, size from members), (select unnest(range({BLOCKS})) as rep), (select unnest(range(20)) as slot) where slot < size),
stats as (select gas, method, rep, median(x) as stat from draws join members using (gas, method, draw) group by 1, 2, 3)"""


@query(f"""with {_COND}, {_BOOT}, sz as (select gas, method, max(size) as size from members group by 1, 2)
select gas, method, count(*) as reps, size, round(case when size >= 3 then quantile_cont(stat, 0.025) end, 6) as low, round(case when size >= 3 then quantile_cont(stat, 0.975) end, 6) as high from stats join sz using (gas, method) group by gas, method, size""")
def j05_block_bootstrap(spark, sf_dir):
    c = cut(_conditions(spark, sf_dir))
    s = resample.bootstrap_statistic(c, ["gas", "method"], "gap_hours", "rmse", BLOCKS, "block", F.median("x"))
    size = c.groupBy("gas", "method").agg(F.count(F.lit(1)).alias("size"))
    d = resample.interval(s, ["gas", "method"], size, 3)
    return d.select("gas", "method", "reps", "size", F.round("low", 6).alias("low"), F.round("high", 6).alias("high"))


_SAMPLES = f"""{monthly_sql()}, {_DECOMP}, i as (select place, gas, mo, mo - row_number() over (partition by place, gas order by mo) run from dec), rr as (select place, gas, run, min(mo) a, max(mo) b from i group by 1, 2, 3),
  bl as (select place, gas, s0, row_number() over (partition by place, gas order by s0) - 1 as draw from (select place, gas, unnest(range(a, b - 12 + 2)) s0 from rr where b - a + 1 >= 12)), bs as (select place, gas, count(*) size from bl group by 1, 2),
pl as (select place, gas, run, mo, (row_number() over w - 1) % 12 as inside, (row_number() over w - 1) // 12 as chunk from i window w as (partition by place, gas, run order by mo)),
ch as (select place, gas, run, chunk, min(mo) cs from pl group by 1, 2, 3, 4),
dr as (select ch.*, rep, ('0x' || substr(sha256('trend|' || place || '|' || gas || '|' || rep::varchar || '|' || cs::varchar), 1, 15))::bigint % size as draw from ch join bs using (place, gas), (select unnest(range({TRENDS})) rep)),
tg as (select pl.place, pl.gas, dr.rep, pl.mo, bl.s0 + pl.inside as src from pl join dr using (place, gas, run, chunk) join bl on bl.place = dr.place and bl.gas = dr.gas and bl.draw = dr.draw),
sm as (select tg.place, tg.gas, tg.rep, tg.mo, dec.residual as sample from tg join dec on dec.place = tg.place and dec.gas = tg.gas and dec.mo = tg.src)"""


def moving_blocks(spark, sf_dir):
    """Every replicate's residual of every month."""
    r = written(trend.decompose(monthly(spark, sf_dir), ["place", "gas"], "mo", "mean"))
    d = resample.moving_block_sample(r, ["place", "gas"], "mo", "residual", 12, TRENDS, "trend")
    return d.select("place", "gas", F.col("rep").cast("long").alias("rep"), "mo", F.round(F.col("sample") + 1.2345e-7, 3).alias("sample"))  # off the ties of rounding


@query(f"""with {_SAMPLES}, rs as (select place, gas, mo, round(sample + 1.2345e-7, 3) as x from sm)
select place, gas, mo, count(*) as reps, min(x) as lowest, max(x) as highest, round(avg(x) + 1.2345e-7, 2) as mean from rs group by 1, 2, 3""")
def j03_moving_block(spark, sf_dir):
    """The replicates of each month, of which moving_blocks has the rows, summed up."""
    return moving_blocks(spark, sf_dir).groupBy("place", "gas", "mo").agg(
        F.count(F.lit(1)).alias("reps"), F.min("sample").alias("lowest"), F.max("sample").alias("highest"), F.round(F.avg("sample") + 1.2345e-7, 2).alias("mean"))


def _trend_bootstrap(spark, sf_dir, count: int = TRENDS):
    dec = written(trend.decompose(monthly(spark, sf_dir), ["place", "gas"], "mo", "mean"))
    sample = resample.moving_block_sample(dec, ["place", "gas"], "mo", "residual", 12, count, "trend")
    pseudo = sample.join(dec.select("place", "gas", "mo", (F.col("fitted") + F.col("seasonal")).alias("base")), ["place", "gas", "mo"]).withColumn("y", F.col("base") + F.col("sample"))
    return trend.sen_slope(pseudo, ["place", "gas", "rep"], "mo", "y", True), dec


_SLOPES = f"""{_SAMPLES}, ps as (select sm.place, sm.gas, rep, sm.mo, fitted + seasonal + sample as y from sm join dec on dec.place = sm.place and dec.gas = sm.gas and dec.mo = sm.mo),
rs as (select a.place, a.gas, a.rep, median((b.y - a.y) / ((b.mo - a.mo) / 12.0::double)) as slope from ps a join ps b on a.place = b.place and a.gas = b.gas and a.rep = b.rep and a.mo % 12 = b.mo % 12 and a.mo < b.mo group by 1, 2, 3)"""


@query(f"""with {_SLOPES}, q as (select place, gas, quantile_cont(slope, 0.025) lo, quantile_cont(slope, 0.975) hi, stddev_samp(slope) sd from rs group by 1, 2)
select place, gas, round(sl.slope, 3) as estimate, round(lo, 3) as low, round(hi, 3) as high, round(2 * sl.slope - hi, 3) as basic_low, round(2 * sl.slope - lo, 3) as basic_high,
  round(sl.slope - 1.959963984540054 * sd, 3) as normal_low, round(sl.slope + 1.959963984540054 * sd, 3) as normal_high from q join sl using (place, gas)""")
def j04_trend_bootstrap(spark, sf_dir):
    slopes, dec = _trend_bootstrap(spark, sf_dir)
    est = trend.sen_slope(dec, ["place", "gas"], "mo", "mean", True).select("place", "gas", F.col("slope").alias("estimate"))
    d = trend.percentile_interval(slopes.join(est, ["place", "gas"]), ["place", "gas"], "slope", F.col("estimate"))
    return d.select("place", "gas", *[F.round(c, 3).alias(c) for c in ("estimate", "low", "high", "basic_low", "basic_high", "normal_low", "normal_high")])


@query(f"""with {_SLOPES}, ce as (select place, gas, rep, slope - avg(slope) over (partition by place, gas) as error from rs),
pc as (select place, gas, slope as estimate, row_number() over (partition by gas order by place) - 1 as draw, count(*) over (partition by gas) as size from sl where exists (select 1 from bs where bs.place = sl.place and bs.gas = sl.gas)),
od as (select gas, rep, slot, ('0x' || substr(sha256('outer|' || gas || '|' || rep::varchar || '|' || slot::varchar), 1, 15))::bigint % size as draw,
  ('0x' || substr(sha256('inner|' || gas || '|' || rep::varchar || '|' || slot::varchar), 1, 15))::bigint % {TRENDS} as inner_rep
  from (select distinct gas, size from pc), (select unnest(range({COHORTS})) rep), (select unnest(range(100)) slot) where slot < size),
st as (select od.gas, od.rep, median(estimate + error) as stat from od join pc on pc.gas = od.gas and pc.draw = od.draw join ce on ce.place = pc.place and ce.gas = pc.gas and ce.rep = od.inner_rep group by 1, 2)
select gas, count(*) as reps, round(quantile_cont(stat, 0.025), 3) as low, round(quantile_cont(stat, 0.975), 3) as high from st group by 1""")
def j07_cohort(spark, sf_dir):
    """Two-stage: places are drawn anew and each drawn place brings one of its centred temporal errors; medians per gas."""
    slopes, dec = _trend_bootstrap(spark, sf_dir)
    slopes = cut(slopes)
    est = trend.sen_slope(dec, ["place", "gas"], "mo", "mean", True).select("place", "gas", F.col("slope").alias("estimate"))
    centred = slopes.withColumn("error", F.col("slope") - F.avg("slope").over(Window.partitionBy("place", "gas"))).select("place", "gas", F.col("rep").alias("inner"), "error")
    w = Window.partitionBy("gas").orderBy("place")
    places = cut(est.join(slopes.select("place", "gas").distinct(), ["place", "gas"], "left_semi").withColumn("draw", (F.row_number().over(w) - 1).cast("long")))
    size = places.groupBy("gas").agg(F.count(F.lit(1)).alias("size"))
    draws = resample.replicates(size, "size", COHORTS, "outer", F.col("gas"))
    picked = draws.join(places, ["gas", "draw"]).withColumn("inner", hash_draw(TRENDS, "inner", F.col("gas"), F.col("rep").cast("string"), F.col("slot").cast("string")).cast("int"))
    both = picked.join(centred, ["place", "gas", "inner"])
    stat = both.groupBy("gas", "rep").agg(F.median(F.col("estimate") + F.col("error")).alias("stat"))
    d = resample.interval(stat, ["gas"])
    return d.select("gas", "reps", F.round("low", 3).alias("low"), F.round("high", 3).alias("high"))


@query(f"""with {monthly_sql()}, xy as (select gas, place, avg(n) x, avg(mean) y from monthly group by 1, 2), mem as (select *, row_number() over (partition by gas order by place) - 1 as draw, count(*) over (partition by gas) as size from xy),
dr as (select gas, rep, slot, ('0x' || substr(sha256('spearman|' || gas || '|' || rep::varchar || '|' || slot::varchar), 1, 15))::bigint % size as draw from (select distinct gas, size from mem), (select unnest(range({RANKS})) rep), (select unnest(range(100)) slot) where slot < size),
s as (select gas, rep, x, y from dr join mem using (gas, draw)),
r as (select gas, rep, rank() over (partition by gas, rep order by x) + (count(*) over (partition by gas, rep, x) - 1) / 2.0 rx, rank() over (partition by gas, rep order by y) + (count(*) over (partition by gas, rep, y) - 1) / 2.0 ry from s),
c as (select gas, rep, corr(rx, ry) c from r group by 1, 2 having count(distinct rx) > 1 and count(distinct ry) > 1)
select gas, count(*) as reps, round(quantile_cont(c, 0.025), 6) as low, round(quantile_cont(c, 0.975), 6) as high from c group by 1""")
def j01_bootstrap_spearman(spark, sf_dir):
    xy = monthly(spark, sf_dir).groupBy("gas", "place").agg(F.avg("n").alias("x"), F.avg("mean").alias("y"))
    w = Window.partitionBy("gas").orderBy("place")
    mem = cut(xy.withColumn("draw", (F.row_number().over(w) - 1).cast("long")))
    size = mem.groupBy("gas").agg(F.count(F.lit(1)).alias("size"))
    s = resample.replicates(size, "size", RANKS, "spearman", F.col("gas")).join(mem, ["gas", "draw"])
    live = s.groupBy("gas", "rep").agg(F.countDistinct("x").alias("dx"), F.countDistinct("y").alias("dy")).where("dx > 1 and dy > 1").select("gas", "rep")
    c = seq.spearman(s.join(live, ["gas", "rep"]), ["gas", "rep"], "x", "y").withColumnRenamed("rho", "stat")
    d = resample.interval(c, ["gas"])
    return d.select("gas", "reps", F.round("low", 6).alias("low"), F.round("high", 6).alias("high"))


#: The injected events as SQL, up to ``inj``: key, event, repetition, pos, h, v, injected, truth.
_INJECT = f"""{HOURLY}, {_SEGMENT}, st as (select *, v - lag(v) over (partition by record_id order by pos) as d from seg),
md as (select record_id, median(v) mv, median(d) m_d from st group by 1), sc as (select record_id, greatest(1.4826 * median(abs(d - m_d)), 1.4826 * median(abs(v - mv)) * 0.05, 1e-3) as scale, count(*) as len, greatest(20, count(*) // 100) as k from st join md using (record_id) group by 1),
ev as (select * from (values {", ".join(f"('{e}', {w}, {a}::double, {lo}, {hi})" for e, (w, a, lo, hi) in resample.EVENTS.items())}) t(event, w, a, lo, hi)),
al as (select seg.record_id, seg.pos, seg.h, seg.v, scale, k, event, w, a, rep as repetition, pos >= lo and pos < len - hi and (event <> 'season_dependent_positive' or month(make_timestamp(h * 3600000000)) in (1, 2, 7, 8)) as inside,
  sha256('injection|' || seg.record_id || '|' || event || '|' || rep::varchar || '|' || pos::varchar) as hash from seg join sc using (record_id), ev, (select unnest(range(1, {REPETITIONS + 1})) as rep)),
sp as (select *, (inside and row_number() over (partition by record_id, event, repetition, inside order by hash) <= case when w > 1 then greatest(3, k // 2) else k end)::int as begins from al),
hits as (select *, case when w > 1 then sum(begins) over (partition by record_id, event, repetition order by pos rows between 5 preceding and current row) else begins end as times from sp),
inj as (select record_id, event, repetition, pos, h, v, v + times * a * scale as injected, times > 0 as truth from hits)"""


@query(f"with {_INJECT} select record_id, event, repetition, pos, v, truth, round(injected, 5) as injected from inj")
def j09_injection(spark, sf_dir):
    """Five events, each put 20 times into every longest segment; j12 runs the detectors over them."""
    d = _injected(spark, sf_dir)
    return d.select("record_id", "event", "repetition", "pos", "v", "truth", F.round("injected", 5).alias("injected"))


def _injected(spark, sf_dir):
    return resample.inject_events(_segment(spark, sf_dir), "record_id", "pos", "h", "v", REPETITIONS, "injection")


@query()
def j11_placements(spark, sf_dir):
    """Artificial gaps of seven lengths in every season of every record's longest segment: the anchor and up to 20 disjoint ones."""
    return _placements(_segment(spark, sf_dir))


def _placements(segment):
    d = resample.season_placements(segment, "record_id", "pos", "h", "gap")
    role = F.when(F.col("placement") == 0, "HISTORICAL_ANCHOR").otherwise("REPEATED_DESIGN")
    return d.withColumns({"role": role, "gap_id": F.substring(F.sha2(F.concat_ws("|", "record_id", "season", "gap_hours", "h"), 256), 1, 24)}).drop("h")


@query(f"""with {_COND}, {_BOOT}, d as (select gas, method, count(*)::double n, avg(stat) m, median(stat) md, stddev_samp(stat) sd, skewness(stat) sk, kurtosis(stat) ku from stats group by 1, 2)
select gas, method, round(m, 6) as mean, round(md, 6) as median, round(sd, 6) as sd, round(case when sd > 1e-12 then sk end, 5) as skew, round(case when sd > 1e-12 then ku end, 4) as excess from d""")
def d36_diagnose(spark, sf_dir):
    s = resample.bootstrap_statistic(cut(_conditions(spark, sf_dir)), ["gas", "method"], "gap_hours", "rmse", BLOCKS, "block", F.median("x"))
    g = s.groupBy("gas", "method").agg(F.count(F.lit(1)).cast("double").alias("n"), F.avg("stat").alias("m"), F.median("stat").alias("md"), F.stddev("stat").alias("sd"), F.skewness("stat").alias("g1"), F.kurtosis("stat").alias("g2"))
    n = F.col("n")
    skew = F.col("g1") * F.sqrt(n * (n - 1)) / (n - 2)
    excess = ((n + 1) * F.col("g2") + 6) * (n - 1) / ((n - 2) * (n - 3))
    live = F.col("sd") > 1e-12
    return g.select("gas", "method", F.round("m", 6).alias("mean"), F.round("md", 6).alias("median"), F.round("sd", 6).alias("sd"), F.round(F.when(live, skew), 5).alias("skew"), F.round(F.when(live, excess), 4).alias("excess"))
