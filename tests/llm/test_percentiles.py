import datetime as dt
import math
import random

import numpy as np
import pytest

from skytally.llm import percentiles

SCHEMA = "run_day date, gas string, method string, gap_hours int, median_rmse double, median_mae double, n int, value int, day int"


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(8)
    out = []
    for i in range(6000):
        g = ("CO2", "CH4", None)[0 if i % 3 else rng.randint(0, 2)]
        v = rng.choice([None, math.nan, 0.0, -0.0, 1e9]) if rng.random() < 0.05 else round(rng.lognormvariate(0, 2), 3)
        out.append((dt.date(2022, 1, 1) + dt.timedelta(days=rng.randint(0, 9)), g, "linear", 3, v, round(rng.random(), 2), 1, 2, 3))
    return out + out[:500]


def check(got, rows, keep=lambda r: True):
    for r in got:
        column = 4 if r["metric"] == "median_rmse" else 5
        v = [x[column] for x in rows if x[1] == r["gas"] and keep(x) and x[column] is not None and x[column] == x[column]]
        assert r["n"] == len(v) and r["error"] == 0.0
        assert r["value"] == pytest.approx(np.quantile(v, r["quantile"]), abs=1e-12, rel=1e-12)


def test_against_brute_force(spark, rows):
    d = spark.createDataFrame(rows, SCHEMA).repartition(7)
    rounds: list[int] = []
    got = percentiles.combine(percentiles.daily_states(d), (0.0, 0.05, 0.5, 0.95, 1.0), log=rounds).collect()
    assert len(got) == 3 * 2 * 5
    assert len(rounds) > 5 and max(rounds) > 6  # six groups and metrics, whose ranges pivot, split and close
    check(got, rows)


def test_salted_ranges_give_the_same(spark, rows, monkeypatch):
    monkeypatch.setattr(percentiles, "BROADCAST_ROWS", 1)
    check(percentiles.combine(percentiles.daily_states(spark.createDataFrame(rows[:400], SCHEMA)), (0.25, 0.5)).collect(), rows[:400])


def test_group_numbers_tell_nulls_apart(spark):
    d = spark.createDataFrame([(None, "a", 1.0, 1), ("a", None, 2.0, 1), ("a", "a", 3.0, 2), (None, None, 4.0, 1)], "x string, y string, value double, n long")
    values, groups = percentiles.group_ids(d, ["x", "y"])
    assert values.select("gid").distinct().count() == groups.count() == 4


def test_days_combine(spark, rows):
    states = percentiles.daily_states(spark.createDataFrame(rows, SCHEMA))
    day = dt.date(2022, 1, 4)
    check(percentiles.combine(states.where("day = '2022-01-04'"), (0.5,)).collect(), rows, lambda r: r[0] == day)
    check(percentiles.combine(states.where("day <> '2022-01-04'"), (0.5,)).collect(), rows, lambda r: r[0] != day)


def test_empty_and_single(spark):
    d = spark.createDataFrame([(None, None, None, None, 5.0, None, 1, 1, 1)], SCHEMA)
    assert percentiles.combine(percentiles.daily_states(d.limit(0))).count() == 0
    assert {r["value"] for r in percentiles.combine(percentiles.daily_states(d)).collect()} == {5.0}
