"""Problem 6: implausible spikes, stuck values and impossible readings."""

from __future__ import annotations

import numpy as np
import pandas as pd
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skytally.operators.skew import blocks_with_halo, positions
from skytally.sources.tables import good_reading

#: Dry-air mole fractions outside these limits occur nowhere in open air.
BOUNDS = {"ppm": (200.0, 2000.0), "ppb": (800.0, 10000.0)}
#: Readings on each side of the rolling median; more than twice the longest spike.
CENTRE_HALF = 6
#: Readings on each side of the rolling scale, which is taken at every SCALE_STEP-th reading.
SCALE_HALF, SCALE_STEP = 512, 64
#: The scale is at least this share of the usual step between neighbours.
STEP_SHARE = 0.5
#: A spike stands at least so many robust standard deviations off, for at most so many readings.
THRESHOLD, MAX_SPIKE = 11.5, 4
#: Equal readings in a row that count as stuck.
MIN_STUCK = 6
BLOCK_ROWS, HALO_ROWS = 16_384, 1024
BUCKET_US = 16 * 86_400_000_000


def _rolling_median(x: np.ndarray, half: int) -> np.ndarray:
    if len(x) == 0:
        return x
    if len(x) == 1:
        return x.copy()
    padded = np.pad(x, half, mode="reflect" if len(x) > half else "symmetric")
    return np.median(sliding_window_view(padded, 2 * half + 1), axis=1)


def _rolling_mad(a: np.ndarray, pos: np.ndarray) -> np.ndarray:
    """Rolling 1.4826 x median of distances at every SCALE_STEP-th place of the record; each reading takes the nearest one.

    Places are counted from the record's start, not the block's, so a cut doesn't move them.
    """
    place = np.rint(pos / SCALE_STEP).astype(np.int64)
    points, which = np.unique(place, return_inverse=True)
    lo = np.searchsorted(pos, points * SCALE_STEP - SCALE_HALF)
    hi = np.searchsorted(pos, points * SCALE_STEP + SCALE_HALF, side="right")
    s = 1.4826 * np.array([np.median(a[i:j]) for i, j in zip(lo, hi)])
    return s[which]


def _rolling_scale(x: np.ndarray, centre: np.ndarray, pos: np.ndarray) -> np.ndarray:
    """Usual scatter around the course, but not under a share of the usual step.

    On a smooth slope the median of a window is its middle reading, so distances alone
    would call a steady course scatter-free.
    """
    s = _rolling_mad(np.abs(x - centre), pos)
    if len(x) > 1:
        step = np.abs(np.diff(x))
        s = np.maximum(s, STEP_SHARE * _rolling_mad(np.r_[step[:1], step], pos))
    return np.maximum(s, 1e-9)


def _runs(same: np.ndarray) -> np.ndarray:
    """Length of the run that each element belongs to; same[i]: i continues the run of i-1."""
    ids = np.cumsum(~same) - 1
    return np.bincount(ids)[ids]


def hampel_block(us: np.ndarray, pos: np.ndarray, value: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> dict[str, np.ndarray]:
    """Flags of one block in the order given. ``pos`` is each reading's place in its record by (us, row_id) and need not be sorted."""
    order = np.argsort(pos, kind="stable")
    u, v, place = us[order], value[order], pos[order]
    possible = (v >= lo[order]) & (v <= hi[order])
    stuck = _runs(np.r_[False, v[1:] == v[:-1]]) >= MIN_STUCK if len(v) else np.zeros(0, bool)
    centre, scale, spike = np.full(len(v), np.nan), np.full(len(v), np.nan), np.zeros(len(v), bool)
    if possible.any():
        pu, pv = u[possible], v[possible]
        last = np.r_[pu[1:] != pu[:-1], True]  # of one instant's deliveries the last stands for it
        x = pv[last]
        c = _rolling_median(x, CENTRE_HALF)
        s = _rolling_scale(x, c, place[possible][last])
        far = np.abs(x - c) > THRESHOLD * s
        far &= _runs(np.r_[False, far[1:] == far[:-1]]) <= MAX_SPIKE
        instant = np.cumsum(np.r_[True, pu[1:] != pu[:-1]]) - 1
        # another delivery of the same instant is judged by its own value, if the instant is in a spike or between normal neighbours
        away = np.abs(pv - c[instant]) > THRESHOLD * s[instant]
        calm = ~(np.abs(x - c) > THRESHOLD * s)
        centre[possible], scale[possible] = c[instant], s[instant]
        spike[possible] = away & (far | calm)[instant]
    back = np.empty(len(order), int)
    back[order] = np.arange(len(order))
    return {"centre": centre[back], "scale": scale[back], "is_spike": spike[back], "is_stuck": stuck[back], "is_impossible": ~possible[back]}


OUT = "row_id long, record_id string, value double, centre double, scale double, is_spike boolean, is_stuck boolean, is_impossible boolean"


def _flag(pdf: pd.DataFrame) -> pd.DataFrame:
    unit = pdf["unit"].str.strip().str.lower()
    lo = unit.map({u: b[0] for u, b in BOUNDS.items()}).fillna(-np.inf).to_numpy(float)
    hi = unit.map({u: b[1] for u, b in BOUNDS.items()}).fillna(np.inf).to_numpy(float)
    flags = hampel_block(pdf["us"].to_numpy(), pdf["pos"].to_numpy(), pdf["value"].to_numpy(float), lo, hi)
    out = pd.DataFrame({"row_id": pdf["row_id"], "record_id": pdf["record_id"], "value": pdf["value"], **flags})
    return out[pdf["core"].to_numpy()]


def flag_implausible(obs: DataFrame) -> DataFrame:
    """Every good reading with its Hampel centre and scale and three flags.

    is_spike: off the rolling median of its record by more than THRESHOLD rolling robust
    standard deviations, in a stretch of at most MAX_SPIKE instants. is_stuck: in a run of
    MIN_STUCK or more good readings of exactly one value, by (timestamp_utc, row_id).
    is_impossible: outside BOUNDS of its unit.

    Records are cut into blocks of consecutive readings with a halo on both sides that
    covers every window, so a record of any size spreads over tasks; flags don't depend on
    where the cuts fall (unless over 400 impossible or repeated readings in a row stand at
    one, which leaves windows there with fewer readings). Defined cases: rows
    with a null in record_id, row_id, value, timestamp_utc or qc_valid are no readings and
    don't appear; an unknown unit has no bounds; several deliveries of one instant each get
    a row; an empty table gives no rows; other columns of the input are ignored.
    """
    good = obs.where(good_reading() & F.col("record_id").isNotNull() & F.col("row_id").isNotNull()).select(
        "row_id", "record_id", F.unix_micros("timestamp_utc").alias("us"), "value", F.coalesce("unit", F.lit("")).alias("unit"))
    numbered = positions(good, "record_id", F.floor(F.col("us") / BUCKET_US).cast("long"), ["us", "row_id"])
    blocks = blocks_with_halo(numbered, "pos", BLOCK_ROWS, HALO_ROWS)
    return blocks.groupBy("record_id", "block").applyInPandas(_flag, OUT)


def implausible_rows(obs: DataFrame) -> DataFrame:
    return flag_implausible(obs).where("is_spike or is_stuck or is_impossible").select("row_id")
