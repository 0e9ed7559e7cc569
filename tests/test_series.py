"""Series operators on hand-computed cases."""

import io
import math
import tarfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from skytally.functions import columns as fx
from skytally.operators import cohort, detect, diff, fill, resample, sequences, trend
from skytally.operators.rolling import rolling_centre_and_scale
from skytally.sources import archive, sinks, text
from skytally.streaming import folds


def series(spark, values, key="a"):
    return spark.createDataFrame([(key, i, None if v is None else float(v)) for i, v in enumerate(values)], "key string, mo long, v double")


def one(df):
    return df.collect()[0]


def test_qc_and_sentinels(spark):
    d = spark.createDataFrame([("1",), (" 2 ",), ("3",), ("9",), (None,), ("",)], "q string").select(fx.qc_decision(F.col("q")).alias("d")).collect()
    assert [r.d.standard for r in d] == ["valid_background", "valid", "invalid", "unknown", "unknown", "unknown"]
    assert [r.d.retain for r in d] == [True, True, False, False, False, False] and d[5].d.original is None
    v = spark.createDataFrame([(-999.0,), (-999.999,), (-2e6,), (1.0,)], "v double").select(fx.without_sentinel(F.col("v"))).collect()
    assert [r[0] for r in v] == [-999.0, None, None, 1.0]


def test_strict_factor_raises(spark):
    d = spark.createDataFrame([("furlong", "CO2")], "u string, g string")
    with pytest.raises(Exception, match="no factor"):
        d.select(fx.strict_factor(F.col("u"), F.col("g"))).collect()
    assert one(d.select(fx.strict_factor(F.col("u"), F.col("g"), False)))[0] is None


@pytest.mark.parametrize(("year", "month", "hours"), [(2024, 2, 696), (2023, 2, 672), (2024, 1, 744), (2024, 4, 720)])
def test_month_hours(spark, year, month, hours):
    assert one(spark.range(1).select(fx.month_hours(F.lit(year * 12 + month - 1))))[0] == hours


def test_runs_and_blocks(spark):
    d = spark.createDataFrame([("a", m) for m in (0, 1, 3, 4)], "key string, mo long")
    b = lambda n: sorted(r["start"] for r in sequences.candidate_blocks(d, ["key"], "mo", n).collect())
    assert b(2) == [0, 3] and b(3) == []
    assert sorted(r["n"] for r in sequences.islands_by_step(d, ["key"], "mo").groupBy("run").agg(F.count("*").alias("n")).collect()) == [2, 2]


def test_longest_segment_ties_and_centre(spark):
    d = spark.createDataFrame([("a", m) for m in (*range(0, 5), *range(10, 15), *range(20, 22))], "key string, mo long")
    got = sorted((r["pos"], r["mo"]) for r in sequences.longest_segment(d, "key", "mo", 3).collect())
    assert got == [(0, 1), (1, 2), (2, 3)]


def test_tolerant_choice(spark):
    d = spark.createDataFrame([("k", "a", 0.5, 0.03), ("k", "b", 0.5, 0.02), ("k", "c", 0.4, 0.0)], "key string, name string, f1 double, fpr double")
    assert one(sequences.pick_with_tolerance(d, ["key"], [("f1", "max"), ("fpr", "min")], "name", 1e-9))["name"] == "b"
    assert one(sequences.pick_with_tolerance(d, ["key"], [("f1", "max"), ("fpr", "min")], "name", 0.2))["name"] == "a"


def test_trend_of_a_ramp(spark):
    d = series(spark, [1.25 * i / 12 for i in range(36)])
    assert one(trend.sen_slope(d, ["key"], "mo", "v", True))["slope"] == pytest.approx(1.25)
    assert one(trend.sen_slope(d, ["key"], "mo", "v"))["slope"] == pytest.approx(1.25)
    r = one(trend.sen_interval(d, ["key"], "mo", "v"))
    assert r["low"] == pytest.approx(1.25) and r["high"] == pytest.approx(1.25)
    assert one(trend.seasonal_kendall(d, ["key"], "mo", "v"))["s"] == 36.0


def test_decomposition_identity(spark):
    d = series(spark, [2 * i / 12 + math.sin(math.pi * i / 6) for i in range(36)])
    rows = trend.decompose(d, ["key"], "mo", "v").collect()
    assert max(abs(r["fitted"] + r["seasonal"] + r["residual"] - r["v"]) for r in rows) < 1e-12
    assert max(abs(r["residual"]) for r in rows) < 1e-9


def test_amplitude(spark):
    r = one(trend.amplitude(series(spark, list(range(12)) * 3), ["key"], "mo", "v"))
    assert (r["amplitude"], r["max_month"], r["min_month"]) == (11.0, 11, 0)
    assert one(trend.amplitude(series(spark, range(7)), ["key"], "mo", "v"))["amplitude"] is None


def test_qualification(spark):
    d = spark.createDataFrame([(540 / 720,), (539 / 720,), (0.0,)], "coverage double")
    assert [r["qualified"] for r in cohort.qualify(d, 0.75).collect()] == [True, False, False]


def test_fills(spark):
    v = [1.0, 2.0, None, None, 8.0, 16.0, None]
    lin = [r["fill"] for r in fill.linear(series(spark, v), ["key"], "mo", "v").orderBy("mo").collect()]
    assert lin == [1.0, 2.0, 4.0, 6.0, 8.0, 16.0, 16.0]
    pch = [r["fill"] for r in fill.pchip(series(spark, v), ["key"], "mo", "v").orderBy("mo").collect()]
    assert pch[6] is None and 2 < pch[2] < pch[3] < 8
    one_hour = fill.one_hour_fill(series(spark, [1.0, None, 3.0, None, None, 6.0]), "key", "mo", "v").where("filled").collect()
    assert [(r["mo"], r["v"]) for r in one_hour] == [(1, 2.0)]
    assert np.isfinite(fill.kalman_level(np.array([1.0, np.nan, 3.0]))).all() and np.isnan(fill.kalman_level(np.array([np.nan]))).all()


def test_gap_metrics_of_constant(spark):
    d = spark.createDataFrame([("a", 1.0, 2.0), ("a", 3.0, 2.0), ("a", 5.0, 2.0)], "key string, t double, f double")
    r = one(fill.gap_metrics(d, ["key"], "t", "f"))
    assert r["corr"] is None and r["max_abs"] == 3.0 and r["bias"] == pytest.approx(-1.0)


def test_rolling_matches_brute_force(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=400)
    rows = {r["mo"]: r for r in rolling_centre_and_scale(series(spark, x), "key", "mo", "v", 7, 9, bucket=50).collect()}
    centre = np.array([np.median(x[max(0, i - 7):i + 8]) for i in range(400)])
    for i in (0, 1, 2, 50, 199, 399):
        n = min(399, i + 7) - max(0, i - 7) + 1
        assert (rows[i]["centre"] is None) == (n < 9)
        if n >= 9:
            assert rows[i]["centre"] == pytest.approx(centre[i])
    inner = np.abs(x - centre)[193:208]
    assert rows[200]["scale"] == pytest.approx(np.median(inner))


@pytest.mark.parametrize("method", detect.METHODS)
def test_detectors_find_a_spike(spark, method):
    v = [400 + math.sin(2 * math.pi * i / 24) + (0.01 * (i % 7)) for i in range(500)]
    v[250] += 30
    found = [r["mo"] for r in detect.flags(series(spark, v), "key", "mo", "v", method, 3.0).where("flag").collect()]
    assert 250 in found
    with pytest.raises(ValueError, match="unknown"):
        detect.flags(series(spark, v), "key", "mo", "v", "none", 3.0)


def test_rates_undefined_are_zero(spark):
    d = spark.createDataFrame([(0, 0, 0, 5)], "tp long, fp long, fn long, tn long")
    r = one(detect.rates(d))
    assert (r["prec"], r["recall"], r["f1"], r["fpr"]) == (0.0, 0.0, 0.0, 0.0)


def test_placements_equal_the_sequential_pass(spark):
    import hashlib

    n, length = 200, 12
    d = spark.createDataFrame([("a", p, n) for p in range(n)], "key string, pos long, n long")
    got = {r["start"] for r in resample.disjoint_placements(d, ["key"], "pos", "n", length, 10, 20, 20, "s").collect()}
    want: list[int] = []
    for p in sorted(range(11, 180), key=lambda p: hashlib.sha256(f"s|a|{p}".encode()).hexdigest()):
        if len(want) < 20 and all(abs(p - q) >= length for q in want):
            want.append(p)
    assert got == set(want)


def test_draws_are_repeatable_and_in_range(spark):
    d = spark.range(1000).select(fx.hash_draw(7, "x", F.col("id").cast("string")).alias("d"))
    a, b = [r[0] for r in d.collect()], [r[0] for r in d.collect()]
    assert a == b and set(a) == set(range(7))
    assert resample.seed("a", 1) != resample.seed("a", 2)


def test_table_diff(spark):
    a = spark.createDataFrame([(1, 1.0, "x"), (2, 2.0, None), (3, 3.0, "z")], "k int, v double, s string")
    b = spark.createDataFrame([(1, 1.0 + 1e-13, "x"), (2, 2.5, None), (4, 3.0, "z")], "k int, v double, s string")
    got = {r["column"]: r for r in diff.table_diff(a, b, ["k"]).collect()}
    assert (got["v"]["rows"], got["v"]["one_sided"], got["v"]["differing"], got["v"]["largest"]) == (4, 2, 1, 0.5) and got["s"]["differing"] == 0


HEADER = ["# site_name : Test", "# dataset_parameter : co2", "# value:units : ppm", "# dataset_LST2UTC : -1", "# VARIABLE ORDER", "#", "# site value QCflag"]


def test_headers(spark):
    rows = [("f", i, t) for i, t in enumerate(HEADER)] + [("g", 0, "# dataset_parameter: CH4"), ("g", 1, "# VARIABLE ORDER"), ("g", 2, "# a b"), ("h", 0, None)]
    got = {r["file"]: r for r in text.parse_headers(spark.createDataFrame(rows, "file string, line_no int, text string")).collect()}
    f = got["f"]
    assert (f["species"], f["unit"], f["lst_to_utc_hours"], f["columns"], f["problem"]) == ("CO2", "ppm", -1.0, ["site", "value", "QCflag"], None)
    assert got["g"]["problem"] == "no unit" and got["h"]["problem"] == "no column order"


def test_archives_and_manifest(spark, tmp_path):
    def tar(name, members):
        with tarfile.open(tmp_path / name, "w:gz") as t:
            for m, body in members:
                i = tarfile.TarInfo(m)
                i.size = len(body)
                t.addfile(i, io.BytesIO(body))

    tar("a.tar.gz", [("d/x_daily.txt", b"no"), ("d/x_HOURLY.txt", b"one\ntwo\n")])
    tar("b.tar.gz", [("../evil_hourly.txt", b"x")])
    (tmp_path / "c.tar.gz").write_bytes(b"junk")
    got = archive.archive_lines(spark, str(tmp_path)).collect()
    assert [r["text"] for r in got if r["path"].endswith("a.tar.gz")] == ["one", "two"]
    assert all(r["problem"] for r in got if not r["path"].endswith("a.tar.gz"))
    m = archive.manifest(spark, str(tmp_path))
    assert m.count() == 3
    bad = m.where("path like 'a%'").selectExpr("path", "'00' as sha256")
    assert {r["state"] for r in archive.verify(m, bad).collect()} == {"changed", "unexpected"}


def test_sinks(spark, tmp_path):
    d = spark.createDataFrame([(1, None), (2, 0.1)], "k int, v double")
    sinks.write_csv(d.coalesce(1), str(tmp_path / "c"))
    assert "1,NA" in "".join(p.read_text() for p in (tmp_path / "c").glob("*.csv"))
    sinks.write_parquet(d, str(tmp_path / "p"), ["k"])
    assert spark.read.parquet(str(tmp_path / "p")).count() == 2
    assert '"v":null' in sinks.summary_json(d).orderBy("json").collect()[0][0]


def test_level_filter_stream(spark, tmp_path):
    spark.sql("select 1L row_id, 'a' record_id, timestamp'2020-01-01 00:00:00' timestamp_utc, 1.0D value, true qc_valid union all "
              "select 2L, 'a', timestamp'2020-01-01 01:00:00', 3.0D, true").coalesce(1).write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema(spark.read.parquet(str(tmp_path / "in")).schema).parquet(str(tmp_path / "in"))
    q = (folds.level_filter(s, 0.1, 1.0).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start())
    q.awaitTermination()
    rows = spark.read.parquet(str(tmp_path / "out")).orderBy("us").collect()
    assert rows[0]["level"] == 1.0 and 1.0 < rows[1]["level"] < 3.0 and not rows[1]["late"]
