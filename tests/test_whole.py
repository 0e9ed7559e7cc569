"""Queries do the whole job: cases that a shortened one gets wrong."""

import hashlib
import os
import urllib.parse

import duckdb
import numpy as np
import pandas as pd
import pytest

from skytally.plans import series, studies


def obs(path, rows):
    """Tables of a folder with only obs_parsed; rows: record_id, hour, value, qc_valid."""
    d = pd.DataFrame(rows, columns=["record_id", "h", "value", "qc_valid"])
    d["timestamp_utc"] = pd.to_datetime(d.pop("h") * 3600, unit="s", utc=True).astype("datetime64[us, UTC]")
    d.assign(unit="ppm", value=d["value"].astype(float)).to_parquet(path / "obs_parsed.parquet")
    return str(path)


def test_segments_keep_6000_hours(spark, tmp_path):
    at = obs(tmp_path, [("a", h, 400 + h % 7, True) for h in range(7001)] + [("b", h, 400 + h % 5, True) for h in (*range(300), *range(400, 500))])
    got = series.e07_longest_segment(spark, at).toPandas()
    a, b = (got[got["record_id"] == r].sort_values("pos") for r in "ab")
    assert a["h"].tolist() == list(range(500, 6500)) and a["pos"].tolist() == list(range(6000))
    assert b["h"].tolist() == list(range(300))
    assert series.d24_gap_metrics(spark, at).where("n > 12").count() == 2


def reference_flags(v, h, method, k):
    """The four detectors as the reference writes them, over one record."""
    x = pd.Series(v, dtype=float)
    hod = pd.Series(np.asarray(h) % 24)
    spread = lambda a: np.median(np.abs(a - np.median(a))) * 1.4826
    if method == "seasonal_mad":
        r = x - x.groupby(hod).transform("median")
        return (r.abs() > k * r.groupby(hod).transform(lambda z: max(spread(z), 1e-9))).to_numpy()
    if method == "iqr_hour":
        a, b = (x.groupby(hod).transform(lambda z, q=q: z.quantile(q)) for q in (0.25, 0.75))
        w = k * 0.5 * (b - a).clip(lower=1e-9)
        return ((x < a - w) | (x > b + w)).to_numpy()
    if method == "rolling_seasonal_mad":
        x, n, least = x - x.groupby(hod).transform("median"), 337, 72
    else:
        n, least = 169, 48
    m = x.rolling(n, center=True, min_periods=least).median()
    s = (x - m).abs().rolling(n, center=True, min_periods=least).median() * 1.4826
    return ((x - m).abs() > k * s.clip(lower=1e-9)).to_numpy()


def reference_rates(flag, truth):
    tp, fp, fn = (flag & truth).sum(), (flag & ~truth).sum(), (~flag & truth).sum()
    p, r = tp / max(tp + fp, 1), tp / max(tp + fn, 1)
    return 2 * p * r / (p + r) if p + r else 0.0, fp / max((~truth).sum(), 1), r, p


CONFIGURATIONS = [(m, k) for m in ("seasonal_mad", "rolling_seasonal_mad", "hampel_7day", "iqr_hour") for k in (3, 4, 5)]


def noisy(seed, n=600, bad=30):
    """Hours with a drift and a daily course; some are off, and most of those are marked. Two readings stand in each hour."""
    rng = np.random.default_rng(seed)
    v = 400 + 0.02 * np.arange(n) + 3 * np.sin(np.arange(n) * np.pi / 12) + rng.normal(0, 0.5, n)
    off = rng.choice(n, bad, replace=False)
    v[off] += rng.choice([-1, 1], bad) * rng.uniform(1, 6, bad)
    truth = np.zeros(n, bool)
    truth[off[: bad * 4 // 5]] = True
    return np.round(v, 4), truth


def scored(records):
    """configuration, record_id, f1, fpr, recall, prec by brute force."""
    out = [(f"{m} k={k}", r, *reference_rates(reference_flags(v, np.arange(len(v)), m, k), t)) for r, (v, t) in records.items() for m, k in CONFIGURATIONS]
    return pd.DataFrame(out, columns=["configuration", "record_id", "f1", "fpr", "recall", "prec"]).sort_values(["configuration", "record_id"], ignore_index=True)


def test_scores_of_all_twelve_configurations(spark, tmp_path):
    records = {f"st0{i}x": noisy(i) for i in range(1, 4)}
    # an hour is judged by all its readings: a good one makes it present, a marked one makes it true
    at = obs(tmp_path, [(r, h, x, ok) for r, (v, t) in records.items() for h, x in enumerate(v) for ok in ((True, False) if t[h] else (True,))])
    want = scored(records)
    got = series._scores(spark, at).toPandas()[want.columns].sort_values(["configuration", "record_id"], ignore_index=True)
    pd.testing.assert_frame_equal(got, want, rtol=1e-9, atol=1e-12)
    best = want.sort_values(["f1", "fpr", "configuration"], ascending=[False, True, True]).groupby("record_id").head(1).set_index("record_id")["configuration"]
    assert {r["record_id"]: r["configuration"] for r in series.f05_lexicographic(spark, at).collect()} == best.to_dict()
    assert {c.split(" ")[0] for c in best} & {"rolling_seasonal_mad", "hampel_7day"}
    assert {r["method"] for r in studies.d23_best_k(spark, at).collect()} == {m for m, _ in CONFIGURATIONS}


def test_hours_with_only_bad_readings_are_judged(spark, tmp_path):
    """Marked hours have no good reading beside them; some have no number; good values are outside 200..10000."""
    records = {f"st0{i}x": noisy(10 + i) for i in range(1, 3)}
    far = {r: (v - 399, t) for r, (v, t) in records.items()}
    at = obs(tmp_path, [(r, h, x, not t[h]) for r, (v, t) in far.items() for h, x in enumerate(v)] + [("st01x", h, x, True) for h, x in ((600, np.nan), (601, -999.0), (602, -9999.0))])
    want = scored(far)
    got = series._scores(spark, at).toPandas()[want.columns].sort_values(["configuration", "record_id"], ignore_index=True)
    pd.testing.assert_frame_equal(got, want, rtol=1e-9, atol=1e-12)
    d16 = {r["record_id"]: r for r in series.d16_metrics(spark, at).collect()}
    for r, (v, t) in far.items():
        flag = reference_flags(v, np.arange(len(v)), "hampel_7day", 3)
        extra = 3 if r == "st01x" else 0
        assert (d16[r]["tp"], d16[r]["fp"], d16[r]["fn"]) == ((flag & t).sum(), (flag & ~t).sum(), (~flag & t).sum() + extra)
        assert d16[r]["tp"] > 0
    assert series.hourly(spark, at).count() == sum((~t).sum() for _, t in far.values())


def test_block_bootstrap_has_5000_replicates(spark, tmp_path):
    x = [0.5, 0.7, 1.1, 1.9, 3.2]
    pd.DataFrame({"gas": "CO2", "gap_hours": [1, 3, 6, 12, 24], "method": "linear", "median_rmse": x, "median_mae": x}).to_parquet(tmp_path / "gap_method_summary.parquet")
    draw = lambda rep, slot: int(hashlib.sha256(f"block|CO2|linear|{rep}|{slot}".encode()).hexdigest()[:15], 16) % 5
    stat = [np.median([x[draw(rep, slot)] for slot in range(5)]) for rep in range(5000)]
    r = series.j05_block_bootstrap(spark, str(tmp_path)).collect()[0]
    assert r["reps"] == 5000 and (r["low"], r["high"]) == pytest.approx(np.percentile(stat, [2.5, 97.5]))
    d = series.d36_diagnose(spark, str(tmp_path)).collect()[0]
    assert (d["mean"], d["sd"]) == pytest.approx((np.mean(stat), np.std(stat, ddof=1)), abs=1e-6)


def test_places_are_nations_and_replicates_2000(spark, tmp_path):
    """Three nations of one region with three years of monthly orders."""
    rng = np.random.default_rng(3)
    at = [(c, f"{1994 + m // 12}-{m % 12 + 1:02d}-05") for c in range(3) for m in range(36)]
    price = np.round(1000 + rng.normal(0, 50, len(at)), 2)
    tables = {
        "orders": pd.DataFrame({"o_custkey": [c for c, _ in at], "o_orderstatus": "F", "o_orderdate": pd.to_datetime([d for _, d in at]).date, "o_totalprice": price}),
        "customer": pd.DataFrame({"c_custkey": range(3), "c_nationkey": range(3)}), "nation": pd.DataFrame({"n_nationkey": range(3), "n_name": list("XYZ"), "n_regionkey": 0}),
        "region": pd.DataFrame({"r_regionkey": [0], "r_name": ["R"]}),
    }
    for name, d in tables.items():
        d.to_parquet(tmp_path / f"{name}.parquet")
    r = series.moving_blocks(spark, str(tmp_path)).selectExpr("count(distinct place) places", "count(distinct rep) reps", "count(*) n").collect()[0]
    assert (r["places"], r["reps"], r["n"]) == (3, 2000, 3 * 36 * 2000)
    c = series.j07_cohort(spark, str(tmp_path)).collect()[0]
    assert c["reps"] == 2000 and c["low"] < c["high"]


def test_five_events_in_twenty_repetitions(spark, tmp_path):
    v, _ = noisy(5, 2400, 1)
    at = obs(tmp_path, [("a", h, x, True) for h, x in enumerate(v)] + [("b", h, 400 + h % 3, True) for h in range(3000, 3060)])
    got = series.j09_injection(spark, at).toPandas()
    a, b = (got[got["record_id"] == r] for r in "ab")
    spread = lambda x: np.median(np.abs(x - np.median(x))) * 1.4826
    scale = max(spread(np.diff(v)), spread(v) * 0.05, 1e-3)
    assert len(a) == 5 * 20 * 2400
    for (event, _), g in a.groupby(["event", "repetition"]):
        g = g.sort_values("pos")
        hit, added = g["truth"].to_numpy(), (g["injected"] - g["v"]).to_numpy() / scale
        at_pos = g["pos"].to_numpy()[hit]
        if event.endswith("shift"):
            times = added / 6 * (1 if event.startswith("positive") else -1)
            assert round(times.sum()) == 12 * 6 and np.allclose(times, times.round(), atol=1e-3)
            assert at_pos.min() >= 100 and at_pos.max() < 2400 - 110 + 5
        else:
            size = {"positive_spikes": 10, "negative_spikes": -10, "season_dependent_positive": 8}[event]
            assert hit.sum() == 24 and np.allclose(added[hit], size, atol=1e-3)
            assert event.startswith("season") or (at_pos.min() >= 50 and at_pos.max() < 2350)
            assert not event.startswith("season") or at_pos.max() < (31 + 28) * 24
        assert np.allclose(added[~hit], 0)
    assert a.groupby("event")["truth"].apply(lambda t: t.to_numpy().reshape(20, -1).sum()).gt(0).all()
    assert not b["truth"].any()
    j = studies.j12_detector_evaluation(spark, at).toPandas()
    assert len(j) == 2 * 5 * 20 * 12
    one = a[(a["event"] == "negative_shift") & (a["repetition"] == 7)].sort_values("pos")
    for m, k in CONFIGURATIONS:
        r = j[(j["record_id"] == "a") & (j["event"] == "negative_shift") & (j["repetition"] == 7) & (j["configuration"] == f"{m} k={k}")].iloc[0]
        flag, truth = reference_flags(one["injected"].to_numpy(), one["pos"].to_numpy(), m, k), one["truth"].to_numpy()
        assert (r["tp"], r["fp"], r["fn"]) == ((flag & truth).sum(), (flag & ~truth).sum(), (~flag & truth).sum())
    assert j[j["record_id"] == "b"]["f1"].isna().all()


def test_copies_of_every_length_are_judged_where_they_are_made(spark, tmp_path):
    rng, rows = np.random.default_rng(8), []
    for n in (1, 2, 25, 47, 48, 71, 72, 85, 86, 101, 110, 121, 169, 170, 211, 240, 420, 2500):
        for kind, v in (("fine", noisy(n, n, 0)[0]), ("coarse", rng.integers(0, 4, n) / 10 + 400), ("flat", np.full(n, 400.0)), ("flat but for few", 400 + (rng.random(n) < 0.03))):
            start = int(rng.integers(0, 9000))
            rows += [(f"{kind} {n}", start + i, x, True) for i, x in enumerate(v)]
    at = obs(tmp_path, rows)
    stored = urllib.parse.urlparse(spark.sparkContext.getCheckpointDir()).path
    before = sorted(os.listdir(stored))
    d = studies.j12_detector_evaluation(spark, at)
    assert sorted(os.listdir(stored)) == before
    assert d._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") < 12
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    con.execute(f"create view obs_parsed as select * from '{at}/obs_parsed.parquet'")
    key = ["configuration", "record_id", "event", "repetition"]
    got, want = (x.sort_values(key).reset_index(drop=True) for x in (d.toPandas(), con.execute(studies.SQL["j12_detector_evaluation"]).df()))
    assert len(got) == 18 * 4 * 5 * 20 * 12
    pd.testing.assert_frame_equal(got, want[got.columns], check_dtype=False, rtol=0, atol=1e-9)


def test_gaps_of_seven_lengths_are_placed_and_filled(spark, tmp_path):
    v, _ = noisy(6, 1300, 1)
    at = obs(tmp_path, [("a", h, x, True) for h, x in enumerate(v)] + [("b", h, x, True) for h, x in enumerate(v[:500])])
    p = series.j11_placements(spark, at).toPandas()
    assert set(p["record_id"]) == {"a"} and set(p["season"]) == {"DJF"} and set(p["gap_hours"]) == {1, 3, 6, 12, 24, 48, 72}
    for length, g in p.groupby("gap_hours"):
        kept = [min(201 + (1000 - 201) // 2, 1300 - length - 200)]
        for q in sorted(range(201, 1000), key=lambda q: hashlib.sha256(f"gap|a|DJF|{length}|{q}".encode()).digest()):
            if len(kept) < 21 and all(abs(q - k) >= length for k in kept):
                kept.append(q)
        assert g.sort_values("placement")["start"].tolist() == kept
    assert (p[p["gap_hours"] == 12]["role"] == "REPEATED_DESIGN").sum() == 20
    j = series.j13_gap_evaluation(spark, at).toPandas()
    assert len(j) == 5 * len(p) and (j["n"] == j["gap_hours"]).all()
    for r in p[p["gap_hours"].isin([12, 72])].itertuples():
        x = np.arange(1300)
        out = (x >= r.start) & (x < r.start + r.gap_hours)
        e = np.interp(x[out], x[~out], v[~out]) - v[out]
        assert j[(j["gap_id"] == r.gap_id) & (j["method"] == "linear")]["rmse"].iloc[0] == pytest.approx(np.sqrt(np.mean(e**2)), abs=2e-5)
