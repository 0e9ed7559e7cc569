"""Row-based rolling medians and scales that hold for keys of any size."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skytally.operators.skew import blocks_with_halo, positions

BLOCK_ROWS = 16_384


def _centred_median(x: np.ndarray, half: int, least: int) -> np.ndarray:
    """Median of the known values among 2*half+1 centred rows; NaN with fewer than ``least`` of them."""
    n = len(x)
    if n == 0:
        return x
    padded = np.concatenate([np.full(half, np.nan), x, np.full(half, np.nan)])
    windows = np.lib.stride_tricks.sliding_window_view(padded, 2 * half + 1)
    known = np.isfinite(windows).sum(1)
    out = np.full(n, np.nan)
    whole = known == 2 * half + 1
    if whole.any():
        out[whole] = np.median(windows[whole], axis=1)
    for i in np.flatnonzero(~whole & (known >= max(1, least))):
        w = windows[i]
        out[i] = np.median(w[np.isfinite(w)])
    return out


def rolling_centre_and_scale(df: DataFrame, key: str, at: str, value: str, half: int, least: int, bucket: int = 4096) -> DataFrame:
    """Adds ``centre`` (rolling median) and ``scale`` (rolling median of each row's distance from its own centre).

    Frames are rows, not time; both need ``least`` known values and are null otherwise. Keys
    are cut into blocks with a halo of two half-frames, which is all that a row's scale
    depends on, so no key has to fit a task. Only key, at and value are kept.
    """
    rows = df.select(key, at, value)
    numbered = positions(rows, key, F.floor(F.col(at) / bucket).cast("long"), [at])
    blocks = blocks_with_halo(numbered, "pos", max(BLOCK_ROWS, 2 * half + 1), 2 * half)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos")
        x = pdf[value].to_numpy(float)
        centre = _centred_median(x, half, least)
        scale = _centred_median(np.abs(x - centre), half, least)
        out = pdf[[key, at, value, "pos"]].copy()
        out["centre"], out["scale"] = centre, scale
        return out[pdf["core"].to_numpy()]

    types = dict(df.dtypes)
    out = blocks.groupBy(key, "block").applyInPandas(run, f"`{key}` {types[key]}, `{at}` {types[at]}, `{value}` double, pos long, centre double, scale double")
    return out.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in ("centre", "scale")})


def group_median(df: DataFrame, key: list[str], value: str, out: str) -> DataFrame:
    """Every row with its group's median."""
    return df.join(df.groupBy(*key).agg(F.median(value).alias(out)), key)


def mad(df: DataFrame, key: list[str], value: str) -> DataFrame:
    """1.4826 times the median distance from the median, per key."""
    far = group_median(df.where(F.col(value).isNotNull()), key, value, "_m")
    return far.groupBy(*key).agg((F.lit(1.4826) * F.median(F.abs(F.col(value) - F.col("_m")))).alias("mad"))
