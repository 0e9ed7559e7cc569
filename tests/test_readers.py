"""Row readers, files and the bucketed sequence tools."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from skytally.operators import fill, readers, sequences, trend
from skytally.operators.skew import previous, running_sum
from skytally.sources import files

RAW = "raw_id long, record_id string, line_no int, raw_line string"
LAYOUT = "record_id string, species string, unit string, lst_to_utc_hours double, columns array<string>, metadata map<string,string>"
COLS = ["site_wdcgg_id", "st_year", "st_month", "st_day", "st_hour", "st_minute", "st_second", "value", "ORG_QCflag", "QCflag"]


@pytest.fixture(scope="module")
def read(spark):
    lay = spark.createDataFrame([("a", "CO2", "mol/mol", -5.5, COLS, {}), ("b", "CH4", "ppm", 1.0, COLS, {}), ("c", "CO2", "furlong", 0.0, COLS, {}), ("d", "CO2", "ppm", None, COLS, {})], LAYOUT)
    lines = [("a", 1, "S 2019 01 01 00 00 00 0.00041 x 1"), ("a", 2, "S 2019 01 01 01 00 00 -999.999 x 2"), ("a", 3, "S 2019 01 01 02 00 00 0.00042 x 3"), ("a", 4, "S 2019 13 01 02 00 00 1 x 1"),
             ("b", 1, "S 2019 01 01 00 00 00 1.9 7 2"), ("b", 2, "S 2019 01 01 00 00 00 1.8 7 2"), ("b", 3, "S 2014 12 31 22 30 00 1.8 7 1"), ("b", 4, "S 2014 12 31 23 00 00 1.8 7 1"), ("b", 5, "# note"),
             ("c", 1, "S 2019 01 01 00 00 00 3 7 1"), ("d", 1, "S 2019 01 01 00 00 00 400 7 "), ("d", 2, "S 2019 01 01 00 00 00 400 7 1"), ("zz", 1, "x"), (None, 1, "x")]
    return spark.createDataFrame([(i, *x) for i, x in enumerate(lines)], RAW), lay


def test_parsed_rows(read):
    raw, lay = read
    got = {(r["record_id"], r["line_no"]): r for r in readers.parsed_rows(raw, lay).collect()}
    a1 = got["a", 1]
    assert (a1["problem"], a1["timestamp_utc"], a1["value"], a1["unit"], a1["qc_original"], a1["qc_valid"]) == (None, dt.datetime(2018, 12, 31, 18, 30), pytest.approx(410.0), "ppm", "x", True)
    assert got["a", 2]["value"] is None and got["a", 2]["qc_standard"] == "valid" and got["a", 3]["qc_valid"] is False
    assert {k: r["problem"] for k, r in got.items() if r["problem"]} == {("a", 4): "clock", ("c", 1): "unknown unit", ("d", 1): "field count", ("d", 2): "no instant", ("zz", 1): "no layout", (None, 1): "no layout"}
    assert got["b", 1]["value"] == pytest.approx(1900.0) and ("b", 5) not in got
    with pytest.raises(Exception, match="clock"):
        readers.parsed_rows(raw, lay, strict=True).collect()
    assert readers.parsed_rows(raw.where("record_id = 'b'"), lay, strict=True).count() == 4


def test_lenient_series(read):
    raw, lay = read
    got = sorted((r["record_id"], r["time"], r["value"], r["qc"], r["valid"]) for r in readers.lenient_series(raw, lay).collect() if r["record_id"] == "b")
    assert [(r[1], r[2], r[4]) for r in got] == [(dt.datetime(2015, 1, 1), pytest.approx(1800.0), True), (dt.datetime(2019, 1, 1, 1), pytest.approx(1900.0), True)]
    rest = {(r["record_id"], r["time"].hour): (r["value"], r["valid"]) for r in readers.lenient_series(raw, lay).collect() if r["record_id"] != "b"}
    assert rest["a", 18] == (pytest.approx(410.0), True) and rest["a", 19] == (None, False) and rest["c", 0] == (3.0, True) and rest["d", 0] == (400.0, True)
    assert readers.lenient_series(raw.limit(0), lay).count() == 0


def test_bucketed_tools_equal_plain_ones(spark):
    rng = random.Random(4)
    rows = [(k, h, rng.randint(0, 1), float(rng.randint(0, 9))) for k in "ab" for h in sorted(rng.sample(range(-9000, 30_000), 900))] + [(None, 5, 1, 1.0)]
    d = spark.createDataFrame(rows, "k string, h long, f int, v double")
    want = {}
    for key in "ab":
        mine = [r for r in rows if r[0] == key]
        total = run = 0
        for i, (_, h, f, v) in enumerate(mine):
            run += int(i > 0 and mine[i - 1][2] != f)
            want[key, h] = (mine[i - 1][1] if i else None, total, run)
            total += f
    bucket = F.floor(F.col("h") / 777).cast("long")
    both = running_sum(previous(d, "k", bucket, ["h"], ["h"], "p"), "k", bucket, ["h"], "f", "before")
    assert {(r["k"], r["h"]): (r["p"]["h"] if r["p"] else None, r["before"]) for r in both.collect()} == {k: w[:2] for k, w in want.items()}
    assert {(r["k"], r["h"]): r["run"] for r in sequences.islands_by_change(d.where("k is not null"), "k", "h", F.col("f") == 1).collect()} == {k: w[2] for k, w in want.items()}
    plain = {(r["k"], r["h"]): r["run"] for r in sequences.islands_by_step(d.where("k is not null"), ["k"], "h").collect()}
    assert {(r["k"], r["h"]): r["run"] for r in sequences.long_islands_by_step(d.where("k is not null"), "k", "h").collect()} == plain
    head = sequences.head_rows(d.where("k is not null"), "k", bucket, ["h"], 10).collect()
    assert sorted((r["k"], r["h"], r["rn"]) for r in head) == sorted((k, h, i + 1) for k in "ab" for i, h in enumerate([r[1] for r in rows if r[0] == k][:10]))


def test_level_filter_equals_the_row_by_row_recursion():
    import numpy as np

    rng = np.random.default_rng(2)
    x = rng.normal(0, 1, 200).cumsum()
    x[[0, 1, 5, 50, 51, 52, 199]] = np.nan
    q, r, level, var = 0.3, 2.0, 1.5, 200.0
    want = []
    for z in x:
        var += q
        if z == z:
            gain = var / (var + r)
            level, var = level + gain * (z - level), var * (1 - gain)
        want.append(level)
    assert np.allclose(fill._filtered(x, q, r, 1.5), want)


def test_daily_slopes(spark):
    d = spark.createDataFrame([("a", i, 2.0 * i + (i % 3)) for i in range(30)] + [("b", 1, 5.0)], "k string, day long, v double")
    got = {r["k"]: r for r in trend.sen_by_key(d, "k", "day", "v", 1.0).collect()}
    v = [2.0 * i + (i % 3) for i in range(30)]
    slopes = sorted((v[j] - v[i]) / (j - i) for i in range(30) for j in range(i + 1, 30))
    assert got["a"]["n_pairs"] == 435 and got["a"]["slope"] == pytest.approx(slopes[217]) and got["b"]["n_pairs"] == 0 and got["b"]["slope"] is None


def test_files(spark, tmp_path):
    (tmp_path / "t.csv").write_bytes("﻿name,n,x\nalpha,1,2.5\nNA,,NA\n".encode())
    assert [tuple(r) for r in files.read_csv(spark, str(tmp_path / "t.csv"), "name string, n int, x double").collect()] == [("alpha", 1, 2.5), (None, None, None)]
    with pytest.raises(Exception):
        files.read_csv(spark, str(tmp_path / "t.csv"), "other string, n int, x double").collect()
    (tmp_path / "c.json").write_text('{"k": [3, 4],\n "of": {"a": 1}}')
    assert files.read_config(spark, str(tmp_path / "c.json")) == {"k": [3, 4], "of": {"a": 1}}
