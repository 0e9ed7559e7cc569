"""Queries of problems 4, 7, 8 and 9 over their whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skytally.llm import abuse, leakage, mixing, percentiles
from skytally.session import prepare
from skytally.sources.tables import table


def p4_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All days: every day's state, combined."""
    found = percentiles.combine(percentiles.daily_states(table(prepare(spark), sf_dir, "gap_method_summary")))
    return found.withColumn("value", F.round("value", 9))


def p4_even_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A set of days, from the same daily states."""
    states = percentiles.daily_states(table(prepare(spark), sf_dir, "gap_method_summary"))
    found = percentiles.combine(states.where(F.dayofmonth("day") % 2 == 0), (0.5, 0.9))
    return found.withColumn("value", F.round("value", 9))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    spark = prepare(spark)
    return leakage.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items")).select("doc_id", "item_id")


def p7_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    spark = prepare(spark)
    return leakage.removal_spans(leakage.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items")))


def p8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    spark = prepare(spark)
    return mixing.mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))[0]


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    spark = prepare(spark)
    return mixing.mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))[1]


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    spark = prepare(spark)
    documents = table(spark, sf_dir, "documents")
    return abuse.score_pages(documents, abuse.fit_on_labels(documents, table(spark, sf_dir, "doc_labels")))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir).where("flagged").select("doc_id")


def p9_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir)


def p9_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return abuse.rates(_scored(spark, sf_dir))


QUERIES = {f.__name__: f for f in (p4_percentiles, p4_even_days, p7_found, p7_spans, p8_mix, p8_shares, p9_found, p9_scores, p9_rates)}
_P4 = """with long as (
  select run_day, gas, method, gap_hours, 'median_rmse' as metric, median_rmse as v from gap_method_summary
  union all select run_day, gas, method, gap_hours, 'median_mae', median_mae from gap_method_summary),
clean as (select * from long where v is not null and not isnan(v) {where}),
q as (select unnest([{qs}]) as quantile)
select gas, method, gap_hours, metric, count(*) as n, quantile, round({pick}, 9) as value, 0.0::double as error
from clean, q group by gas, method, gap_hours, metric, quantile"""


def _p4_sql(qs: tuple[float, ...], where: str = "") -> str:
    pick = "case " + " ".join(f"when quantile = {q}::double then quantile_cont(v, {q})" for q in qs) + " end"
    return _P4.format(qs=", ".join(f"{q}::double" for q in qs), pick=pick, where=where)


SQL: dict[str, str] = {
    "p4_percentiles": _p4_sql(percentiles.QUANTILES),
    "p4_even_days": _p4_sql((0.5, 0.9), "and day(run_day) % 2 = 0"),
}
