"""The core problems against brute force and hand-made cases."""

import csv
import datetime as dt
import io
import itertools
import math
import random
import zoneinfo

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from skytally.operators import grid, rawlines, spikes, timestamps, units
from skytally.operators.skew import blocks_with_halo, join_dimension, positions

UTC = dt.UTC
OBS = "row_id long, record_id string, timestamp_utc timestamp, value double, unit string, qc_valid boolean, received_at timestamp, block long, pos long"


def at(h: float) -> dt.datetime:
    return dt.datetime(2020, 1, 1, tzinfo=UTC) + dt.timedelta(hours=h)


def obs(spark, rows):
    """rows: (row_id, record, hour, value, valid[, received]); block and pos are extra columns that clash with working names."""
    return spark.createDataFrame([(r[0], r[1], None if r[2] is None else at(r[2]), r[3], "ppm", r[4], at(r[5] if len(r) > 5 else 0), 7, 7) for r in rows], OBS)


# positions and blocks

def test_positions_and_halo(spark):
    rows = [(k, random.Random(k).randint(0, 50)) for k in range(300)]
    d = spark.createDataFrame([("a", v, k) for k, v in rows] + [("b", 1, 1)], "key string, t int, id int")
    got = {r["id"]: r["pos"] for r in positions(d.where("key = 'a'"), "key", F.floor(F.col("t") / 7).cast("long"), ["t", "id"]).collect()}
    assert got == {k: i for i, (k, _) in enumerate(sorted(rows, key=lambda x: (x[1], x[0])))}
    cut = blocks_with_halo(positions(d, "key", F.col("t").cast("long"), ["t", "id"]), "pos", 50, 5).collect()
    assert sum(r["core"] for r in cut) == 301
    assert {r["pos"] for r in cut if r["key"] == "a" and r["block"] == 1} == set(range(45, 105))


def test_join_dimension_both_ways(spark):
    facts = spark.createDataFrame([(k % 3 if k % 7 else None, k) for k in range(200)], "key long, x long")
    dim = spark.createDataFrame([(0, "a"), (1, "b")], "key long, name string")
    small = sorted(map(str, join_dimension(facts, dim, ["key"]).collect()))
    large = sorted(map(str, join_dimension(facts, dim, ["key"], max_rows=1).select("key", "x", "name").collect()))
    assert small == large and len(small) == 200


# problem 1

def test_grid_by_hand(spark):
    rows = [(1, "a", 0.5, 10.0, True), (2, "a", 0.75, 20.0, True), (3, "a", 3.5, 40.0, True), (4, "a", 20.5, 50.0, True),
            (5, "a", 2.0, 99.0, False), (6, "a", 2.0, None, True), (7, "a", None, 1.0, True), (8, None, 2.0, 1.0, True), (9, "a", 2.0, 1.0, None),
            (10, "a", 0.75, 30.0, True, 5), (11, "b", 5.0, 1.0, True), (12, "a", 2.0, math.nan, True)]
    out = {(r["record_id"], r["hour_epoch"]): r for r in grid.regular_grid(obs(spark, rows), 6).collect()}
    h = lambda k: int(at(k).timestamp())
    assert len(out) == 22 and out["b", h(5)]["status"] == "observed"
    assert out["a", h(0)]["value"] == 20.0 and out["a", h(0)]["n_readings"] == 2  # the later delivery of 0.75 counts
    assert out["a", h(1)]["status"] == "filled" and out["a", h(1)]["value"] == pytest.approx(30 + 10 * 0.75 / 2.75)
    assert out["a", h(10)]["status"] == "missing" and out["a", h(10)]["value"] is None


def test_grid_over_blocks(spark):
    hours = sorted(random.Random(1).sample(range(0, 9000), 40))
    rows = [(i, "a", h + 0.25, float(i), True) for i, h in enumerate(hours)]
    for block in (5, 64, 1024):
        got = {r["hour_epoch"]: r for r in grid.regular_grid(obs(spark, rows), 300, block).collect()}
        assert len(got) == hours[-1] - hours[0] + 1
        for h in range(hours[0], hours[-1] + 1, 37):
            r = got[int(at(h).timestamp())]
            before, after = [i for i, x in enumerate(hours) if x < h], [i for i, x in enumerate(hours) if x > h]
            if h in hours:
                assert r["status"] == "observed"
            else:
                a, b = before[-1], after[0]
                inside = hours[b] - hours[a] <= 300
                assert r["status"] == ("filled" if inside else "missing")
                if inside:
                    assert r["value"] == pytest.approx(a + (b - a) * (h + 0.5 - hours[a] - 0.25) / (hours[b] - hours[a]))


def test_empty_tables(spark):
    empty = obs(spark, [])
    assert grid.regular_grid(empty).count() == 0
    assert spikes.flag_implausible(empty).count() == 0


# problem 6

def brute_runs(v):
    out = [False] * len(v)
    for _, g in itertools.groupby(range(len(v)), key=lambda i: v[i]):
        g = list(g)
        if len(g) >= spikes.MIN_STUCK:
            for i in g:
                out[i] = True
    return out


def test_spikes_stuck_impossible(spark, monkeypatch):
    rng = np.random.default_rng(3)
    n = 3000
    v = np.round(400 + 8 * np.sin(np.arange(n) / 24 * 2 * np.pi) + rng.normal(0, 0.4, n), 3)
    spike = {100: 60.0, 500: -45.0, 501: -44.0, 900: 50.0, 901: 50.5, 902: 51.0, 903: 49.0, 2999: 70.0}
    for i, x in spike.items():
        v[i] += x
    v[1500:1540] += 60  # a lasting plume
    v[2000:] += 30      # a level change
    v[1200:1207] = v[1200]
    v[2500] = 0.41
    rows = [(i, "a", i * 1.0, float(v[i]), True) for i in range(n)]
    rows += [(n + 1, "a", 100.0, float(v[100]), True), (n + 2, "a", 50.0, None, True), (n + 3, "a", 51.0, 9999.0, False), (n + 4, "b", 0.0, 400.0, True)]
    for block in (8192, 1100):
        monkeypatch.setattr(spikes, "BLOCK_ROWS", block)
        got = {r["row_id"]: r for r in spikes.flag_implausible(obs(spark, rows)).collect()}
        assert len(got) == n + 2
        assert {i for i, r in got.items() if r["is_spike"]} == set(spike) | {n + 1}
        assert {i for i, r in got.items() if r["is_stuck"]} == set(range(1200, 1207))
        assert {i for i, r in got.items() if r["is_impossible"]} == {2500}


def test_flags_do_not_depend_on_the_cut(spark, monkeypatch):
    rng = np.random.default_rng(5)
    n = 9000
    v = np.round(400 + 8 * np.sin(np.arange(n) / 24 * 2 * np.pi) + rng.normal(0, 1, n) * np.linspace(0.2, 3, n), 3)
    v[rng.choice(n, 120, replace=False)] += rng.normal(0, 25, 120)
    v[4090:4110] = 0.3
    rows = [(i, "a", float(i), float(v[i]), True) for i in range(n)] + [(n + i, "a", float(i), float(v[i]), True) for i in range(2000, 2300)]
    seen = []
    for block in (2048, 8192, 16_384):
        monkeypatch.setattr(spikes, "BLOCK_ROWS", block)
        seen.append(sorted(map(str, spikes.flag_implausible(obs(spark, rows)).collect())))
    assert len(seen[0]) == n + 300
    assert seen[0] == seen[1] == seen[2]


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 2), min_size=0, max_size=60))
def test_stuck_runs_match_brute_force(values):
    v = np.array(values, float)
    n = len(v)
    got = spikes.hampel_block(np.arange(n), np.arange(n), v, np.full(n, -9.0), np.full(n, 9.0))
    assert got["is_stuck"].tolist() == brute_runs(values)


# problem 3

def instants(spark, texts, offset=-1.0, order="DMY"):
    d = spark.createDataFrame([(i, t, offset, order) for i, t in enumerate(texts)], "id int, t string, o double, ord string")
    return [None if r["instant_us"] is None else dt.datetime(1970, 1, 1, tzinfo=UTC) + dt.timedelta(microseconds=r["instant_us"])
            for r in timestamps.parse_instants(d, "t", "o", "ord").orderBy("id").collect()]


def test_timestamp_forms(spark):
    u = lambda *a: dt.datetime(*a, tzinfo=UTC)
    cases = {
        "15/02/2023 03:00": u(2023, 2, 15, 2), "2023-048 22:00": u(2023, 2, 17, 21), "202302150530": u(2023, 2, 15, 4, 30), "1717934400": u(2024, 6, 9, 12),
        "1667104200939": u(2022, 10, 30, 4, 30, 0, 939000), "2023-08-23T02:33:00-06:00": u(2023, 8, 23, 8, 33), "2023-12-13 13:10:05 +0100": u(2023, 12, 13, 12, 10, 5),
        "29 Jul 2024 02:00 GMT": u(2024, 7, 29, 2), "26-Jan-2024 9:30 PM": u(2024, 1, 26, 20, 30), "26-Jan-2024 12:05 AM": u(2024, 1, 25, 23, 5), "2023-06-12 10:00 Europe/Vienna": u(2023, 6, 12, 8),
        "2023-03-12 01:30 America/New_York": u(2023, 3, 12, 6, 30), "2023-12-14 21:30:21 CET": u(2023, 12, 14, 20, 30, 21), "2023-07-17T15:00:00.210Z": u(2023, 7, 17, 15, 0, 0, 210000),
        "2024-02-29 24:00": u(2024, 2, 29, 23), "2022-11-06T01:30-02:30": u(2022, 11, 6, 4),
        "2023-02-29 10:00": None, "31/11/2023 10:00": None, "2023-366 10:00": None, "2023-01-01 24:01": None, "2023-01-01 10:60": None, "0000-00-00 00:00": None, "n/a": None, "": None, "  ": None,
        "2023-01-01 10:00 Etc/GMT+5": u(2023, 1, 1, 15), "2023-01-01 10:00 Japan": u(2023, 1, 1, 1), "2023-07-01 10:00 EST5EDT": u(2023, 7, 1, 14), "2023-07-01 10:00 PM Singapore": u(2023, 7, 1, 14),
        "2023-01-01 10:00 Mars/Olympus": None, "2023-01-01 10:00 QQT": None, "13:00": None, "1 Foo 2023 10:00": None, "x" * 50_000: None, "1\u00012": None,
    }
    assert instants(spark, [*cases, None]) == [*cases.values(), None]
    assert instants(spark, ["03/04/2023 00:00"], 5.5, "MDY") == [u(2023, 3, 4, 5, 30)]
    assert instants(spark, ["03/04/2023 00:00"], None, "MDY") == [None] and instants(spark, ["03/04/2023 00:00", "2023-01-01 00:00Z"], 1.0, None) == [None, u(2023, 1, 1)]


def test_zones_against_zoneinfo(spark):
    rng = random.Random(5)
    assert len(instants(spark, ["2023-01-01 10:00 " + z for z in timestamps.zone_names()])) > 500  # Spark knows them all
    zones = ["Europe/Vienna", "America/Denver", "Australia/Adelaide", "Asia/Kolkata", "America/St_Johns"]
    texts, want = [], []
    for _ in range(200):
        z = rng.choice(zones)
        w = dt.datetime(2022, 1, 1) + dt.timedelta(minutes=30 * rng.randint(0, 48 * 900))
        a, b = w.replace(tzinfo=zoneinfo.ZoneInfo(z)), w.replace(tzinfo=zoneinfo.ZoneInfo(z), fold=1)
        if a.utcoffset() == b.utcoffset():
            texts.append(w.strftime("%Y-%m-%d %H:%M ") + z)
            want.append(a.astimezone(UTC))
    assert instants(spark, texts) == want


def test_days_from_civil(spark):
    days = [dt.date(1, 1, 1), dt.date(1600, 2, 29), dt.date(1900, 3, 1), dt.date(1969, 12, 31), dt.date(2000, 2, 29), dt.date(9999, 12, 31)]
    d = spark.createDataFrame([(x.year, x.month, x.day) for x in days], "y int, m int, d int")
    got = [r[0] for r in d.select(timestamps.days_from_civil(F.col("y"), F.col("m"), F.col("d"))).collect()]
    assert got == [(x - dt.date(1970, 1, 1)).days for x in days]


# problem 2

LAYOUT = "record_id string, species string, unit string, lst_to_utc_hours double, columns array<string>, metadata map<string,string>"


def layout(spark, rows):
    return spark.createDataFrame(rows, LAYOUT)


def test_units(spark):
    lay = layout(spark, [("c", "CO2", "ppm", 0.0, [], {}), ("m", "CH4", "mol mol-1", 0.0, [], {})])
    cases = [  # unit, remark, record, unit_code, factor
        ("PPM ", None, "c", "umol/mol", 1.0), ("μmol mol⁻¹", None, "c", "umol/mol", 1.0), ("nanomol per mol", None, "c", "nmol/mol", 1e-3), ("10^-9 mol/mol", None, "m", "nmol/mol", 1.0),
        ("percent by volume", None, "c", "%", 1e4), ("ppt", None, "m", "pmol/mol", 1e-3), ("micromoll per mol", None, "c", "umol/mol", 1.0), ("ppmv (dry)", None, "m", "umol/mol", 1e3),
        ("-", "values given in mol/mol", "c", "mol/mol", 1e6), (None, "see sheet 2 (nmol/mol)", "m", "nmol/mol", 1.0), ("", "checked against a 500 ppm cylinder", "m", "mol/mol", 1e9),
        ("", "filter changed, 2 ppb offset removed", "c", "umol/mol", 1.0), ("", "logger writes 10-6 mol/mol since the swap", "m", "umol/mol", 1e3), ("furlong", None, "c", None, None),
        ("", "wind from the valley", "c", "umol/mol", 1.0), ("ppm", None, "zz", "umol/mol", None), ("ppm", None, None, "umol/mol", None), ("q" * 5000, "z" * 5000, "c", None, None),
        ("parts        per        million        (dry)        (dry)", None, "c", "umol/mol", 1.0), (None, "log: parts per billion (dry) since May", "c", "nmol/mol", 1e-3),
    ]
    d = spark.createDataFrame([(i, r, 2.0, 2.0, u, k, 1) for i, (u, k, r, _, _) in enumerate(cases)] + [(90, "c", None, 1.0, "ppm", None, 1), (91, "c", -999.999, 1.0, "ppm", None, 1), (92, "c", math.nan, 1.0, "ppm", None, 1)],
                              "row_id long, record_id string, original_value double, value double, unit string, remark string, species int")
    got = {r["row_id"]: r for r in units.convert_units(d, lay).collect()}
    for i, (_, _, _, code, factor) in enumerate(cases):
        assert got[i]["unit_code"] == code, cases[i]
        assert (got[i]["right_value"] is None) == (factor is None)
        if factor is not None:
            assert got[i]["right_value"] == pytest.approx(2 * factor)
    assert all(got[i]["right_value"] is None for i in (90, 91, 92))
    wrong = {r[0] for r in units.wrong_values(d, lay).collect()}
    assert wrong == {i for i, c in enumerate(cases) if c[4] is not None and abs(c[4] - 1) > 1e-9}


def test_edit_cost():
    assert units.edit_cost("ppm", "ppm") == 0 and units.edit_cost("ppm", "ppb") >= 4 and units.edit_cost("mol mol-1", "mol/mol-1") < 1


# problem 5

COLS = ["site_wdcgg_id", "st_year", "st_month", "st_day", "st_hour", "st_minute", "st_second", "value", "remark", "QCflag"]


def test_lines(spark):
    lay = layout(spark, [("c", "CO2", "ppm", 0.0, COLS, {"dataset_delimiter": "comma"}), ("w", "CO2", "ppm", 0.0, COLS[:8] + ["QCflag"], {"dataset_delimiter": "whitespace"}), ("d", "CO2", "ppm", 0.0, ["value", "value"], {})])
    c = "S,2020,02,29,23,00,00,"
    w = "S 2020 02 29 23 00 00 "
    cases = [
        ("c", c + '400.5,"a, ""b""",1', None), ("c", c + "400.5,,1", None), ("c", c + ' 400.5 , "x" ,1', None), ("c", c + '400.5,"x"y,1', "broken quoting"), ("c", c + '400.5,x "y,1', "broken quoting"),
        ("c", c + '400.5,"x,1', "broken quoting"), ("c", c + "400.5,a,b,1", "field count"), ("c", c + "nan,a,1", "number"), ("c", c + ",a,1", "number"), ("c", c + "4e2,a,1", None), ("c", c + "+4.e+2,a,1", None), ("c", c + '"400.5",a,1', None),
        ("c", c + '400.5,"""",1', None), ("c", c + '400.5,"" "",1', "broken quoting"), ("c", c + "1e999,a,1", "number"), ("c", c.replace("29", "30") + "4,a,1", "clock"), ("c", c.replace(",23,", ",24,") + "4,a,1", "clock"), ("c", c.replace("2020", "+2020") + "4,a,1", "clock"),
        ("w", w + "400.5 1", None), ("w", " " + w.replace(" ", "\t  ") + "-999.999 x ", None), ("w", w + "400.5", "field count"), ("w", w + "400,5 1", "number"), ("w", w + '4"5 1', "number"), ("w", " ".join(COLS[:8]) + " QCflag", "clock"), ("w", "=====", "field count"),
        ("zz", w + "400.5 1", "no layout"), (None, w + "1 1", "no layout"), ("d", "1 1", "no layout"), ("w", "x" * 200_000, "field count"),
        ("w", "# note", "skip"), ("w", "   ", "skip"), ("w", "", "skip"), ("w", None, "skip"), ("c", "  # a,b", "skip"),
    ]
    raw = spark.createDataFrame([(i, r, 1, t, None) for i, (r, t, _) in enumerate(cases)], "raw_id long, record_id string, line_no int, raw_line string, columns int")
    got = {r["raw_id"]: r for r in rawlines.load_lines(raw, lay).collect()}
    for i, (_, t, want) in enumerate(cases):
        loaded = None if want == "skip" else want is None
        assert (got[i]["loaded"], got[i]["reason"]) == (loaded, None if want == "skip" else want), t
    assert got[0]["fields"]["remark"] == 'a, "b"' and got[0]["value"] == 400.5 and got[0]["local_time"] == dt.datetime(2020, 2, 29, 23)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.text(alphabet='ab",  \t', max_size=6), min_size=1, max_size=5), min_size=1, max_size=6))
def test_structural_index_round_trip(rows):
    """What a CSV writer quotes comes back field by field."""
    lines = []
    for r in rows:
        s = io.StringIO()
        csv.writer(s, quoting=csv.QUOTE_ALL, lineterminator="").writerow(r)
        lines.append(s.getvalue())
    counts, fields, broken = rawlines.structural_index(pa.array(lines), np.ones(len(lines), bool))
    assert not broken.any()
    assert counts.tolist() == [len(r) for r in rows]
    assert fields.to_pylist() == [x for r in rows for x in r]


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet='a", ', max_size=12))
def test_quoting_against_a_state_machine(line):
    state, ok = "start", True
    for c in line:
        if state == "start":
            state = "quoted" if c == '"' else "start" if c in ", " else "bare"
        elif state == "bare":
            if c == '"':
                ok = False
            state = "start" if c == "," else "bare"
        elif state == "quoted":
            state = "closing" if c == '"' else "quoted"
        elif state == "closing":
            state = "quoted" if c == '"' else "start" if c == "," else "after" if c == " " else "bad"
        elif state == "after":
            state = "start" if c == "," else "after" if c == " " else "bad"
        if state == "bad":
            ok = False
            break
    ok = ok and state != "quoted"
    assert rawlines.structural_index(pa.array([line]), np.ones(1, bool))[2][0] == (not ok), line


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.text(alphabet='ab",. \té1', max_size=12), st.booleans()), min_size=1, max_size=6))
def test_fields_of_mixed_records(rows):
    """Blank-separated and unquoted comma records beside each other."""
    rows = [(t.replace('"', "'") if comma else t, comma) for t, comma in rows]
    counts, fields, broken = rawlines.structural_index(pa.array([t for t, _ in rows]), np.array([c for _, c in rows]))
    want = [[x.strip(" \t") for x in t.split(",")] if comma else t.split() for t, comma in rows]
    assert not broken.any() and counts.tolist() == [len(w) for w in want]
    assert fields.to_pylist() == [x for w in want for x in w]


def test_value_fields_of_any_name_must_be_numbers(spark):
    lay = layout(spark, [("a", "CO2", "ppm", 0.0, ["st_year", "value", "value_sd", "value_wmo_scale"], {"dataset_delimiter": "whitespace"})])
    raw = spark.createDataFrame([(i, "a", 1, t) for i, t in enumerate(["2020 1 2 3", "2020 1 nan 3", "2020 1 2 0x3", "0 1 2 3", "2020 1 -999.999 +3e1"])], "raw_id long, record_id string, line_no int, raw_line string")
    got = {r["raw_id"]: (r["reason"], r["value_wmo_scale"]) for r in rawlines.load_lines(raw, lay, with_fields=False).collect()}
    assert got == {0: (None, 3.0), 1: ("number", None), 2: ("number", None), 3: ("clock", None), 4: (None, 30.0)}