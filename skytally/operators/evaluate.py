"""The four detectors over injected copies of a bounded series, in one task per series."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skytally.operators.detect import FLOOR, KS, METHODS
from skytally.operators.resample import EVENTS

#: Values of the copies that are judged at once.
CELLS = 500_000
WARM = (1, 2, 7, 8)


def _mad(x: np.ndarray) -> float:
    return 1.4826 * float(np.median(np.abs(x - np.median(x))))


def _digest(start, place: int) -> bytes:
    x = start.copy()
    x.update(b"%d" % place)
    return x.digest()


def copies(name: str, pos: np.ndarray, h: np.ndarray, v: np.ndarray, repetitions: int, scope: str) -> list[tuple[np.ndarray, np.ndarray, list[int]]]:
    """The different ones among all copies that resample.inject_events makes of a series: values, truth, and which they stand for.

    A copy's number is that of its event times ``repetitions`` plus that of its repetition, both from 0. Where no more than the wanted
    positions are inside an event's margins, its repetitions are equal, and without any they are the series itself.
    """
    n = len(v)
    scale = max(_mad(np.diff(v)) if n > 1 else 0.0, _mad(v) * 0.05, 1e-3)
    most = max(20, n // 100)
    warm = np.isin(h.astype("datetime64[h]").astype("datetime64[M]").astype(int) % 12 + 1, WARM)
    found: dict[tuple, tuple[np.ndarray, np.ndarray, list[int]]] = {}
    for e, (event, (width, size, low, high)) in enumerate(EVENTS.items()):
        inside = np.flatnonzero((pos >= low) & (pos < n - high) & (warm if event == "season_dependent_positive" else True))
        wanted = max(3, most // 2) if width > 1 else most
        for r in range(repetitions):
            rows = inside
            if len(inside) > wanted:
                start = hashlib.sha256(f"{scope}|{name}|{event}|{r + 1}|".encode())
                rows = np.array(sorted(inside.tolist(), key=lambda i, start=start: _digest(start, pos[i]))[:wanted])
            times = np.zeros(n)
            times[rows] = 1
            if width > 1 and len(rows):
                times = np.convolve(times, np.ones(6))[:n]
            key = (event, times.tobytes()) if len(rows) else ()
            if key not in found:
                found[key] = v + times * size * scale, times > 0, []
            found[key][2].append(e * repetitions + r)
    return list(found.values())


class _Hours:
    """Order statistics of each hour of day, for many copies of a series at once."""

    def __init__(self, h: np.ndarray):
        _, self.of, self.count = np.unique(h % 24, return_inverse=True, return_counts=True)
        order = np.argsort(self.of, kind="stable")
        self.each = np.arange(len(self.count))
        self.rows = np.full((self.count.max(), len(self.count)), len(h))
        self.rows[np.arange(len(h)) - np.repeat(np.cumsum(self.count) - self.count, self.count), self.of[order]] = order

    def sorted(self, x: np.ndarray) -> np.ndarray:
        return np.sort(np.concatenate([x, np.full((len(x), 1), np.nan)], axis=1)[:, self.rows], axis=1)

    def quantile(self, x: np.ndarray, q: float) -> np.ndarray:
        """As Spark interpolates it; x comes from sorted."""
        at = (self.count - 1) * q
        lo, hi = np.floor(at).astype(int), np.ceil(at).astype(int)
        a, b = x[:, lo, self.each], x[:, hi, self.each]
        return np.where((lo == hi) | (a == b), a, (hi - at) * a + (at - lo) * b)[:, self.of]

    def median(self, x: np.ndarray) -> np.ndarray:
        return self.quantile(self.sorted(x), 0.5)


def _rolling_median(x: np.ndarray, half: int, least: int) -> np.ndarray:
    """Median of the known values among 2*half+1 centred columns of each row; NaN with fewer than ``least`` of them."""
    n = x.shape[1]
    if n < least:
        return np.full(x.shape, np.nan)
    if n <= half + 1 and np.isfinite(x).all():  # every window has the whole series
        return np.repeat(np.median(x, axis=1)[:, None], n, axis=1)
    apart = np.concatenate([x, np.full((len(x), half), np.nan)], axis=1)
    return pd.Series(apart.ravel()).rolling(2 * half + 1, center=True, min_periods=least).median().to_numpy().reshape(apart.shape)[:, :n]


def _beyond_rolling(x: np.ndarray, half: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    far = np.abs(x - _rolling_median(x, half, least))
    return far, np.maximum(1.4826 * _rolling_median(far, half, least), FLOOR)  # NaN is beyond nothing


def flags(x: np.ndarray, h: np.ndarray) -> dict[str, list[np.ndarray]]:
    """Flags of every detector of detect at every k of KS; rows of x are copies, columns the hours h in order."""
    hours = _Hours(h)
    by_hour = hours.sorted(x)
    r = x - hours.quantile(by_hour, 0.5)
    seasonal = np.maximum(1.4826 * hours.median(np.abs(r - hours.median(r))), FLOOR)
    q1, q3 = hours.quantile(by_hour, 0.25), hours.quantile(by_hour, 0.75)
    far, scale = _beyond_rolling(x, 84, 48)
    rfar, rscale = _beyond_rolling(r, 168, 72)
    return {
        "seasonal_mad": [np.abs(r) > k * seasonal for k in KS],
        "rolling_seasonal_mad": [rfar > k * rscale for k in KS],
        "hampel_7day": [far > k * scale for k in KS],
        "iqr_hour": [(x < q1 - (k * 0.5 * (q3 - q1) + FLOOR)) | (x > q3 + (k * 0.5 * (q3 - q1) + FLOOR)) for k in KS],
    }


def injected_counts(df: DataFrame, key: str, pos: str, h: str, value: str, repetitions: int, scope: str) -> DataFrame:
    """Every detector at every k over every injected copy of each key's series: tp, fp, fn, tn, key, configuration, copies.

    The copies are those of resample.inject_events. Equal ones are judged once and share a row, see each_copy. A key is one bounded
    segment (see sequences.longest_segment), so its copies are made where they are judged and never shuffled.
    """
    names = [f"{m} k={int(k)}" for m in METHODS for k in KS]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([pos, value])
        name, at, hours = pdf[key].iloc[0], pdf[pos].to_numpy(), pdf[h].to_numpy()
        made = copies(name, at, hours, pdf[value].to_numpy(float), repetitions, scope)
        step, parts = max(1, CELLS // len(pdf)), []
        for i in range(0, len(made), step):
            some = made[i:i + step]
            truth = np.stack([t for _, t, _ in some])
            found = flags(np.stack([x for x, _, _ in some]), hours)
            hit = np.stack([f for m in METHODS for f in found[m]], axis=1)  # copy, configuration, hour
            tp, flagged = (hit & truth[:, None]).sum(2), hit.sum(2)
            true = truth.sum(1)[:, None]
            parts.append(np.stack([tp, flagged - tp, true - tp, len(pdf) - true - flagged + tp], axis=2).reshape(-1, 4))
        out = pd.DataFrame(np.concatenate(parts), columns=["tp", "fp", "fn", "tn"])
        return out.assign(**{key: name, "configuration": names * len(made), "copies": [c for _, _, c in made for _ in names]})

    types = dict(df.dtypes)
    # A shuffle of its own, by number: a join on the key before it may split a large key, and few bytes aren't taken for little work and put into one task.
    apart = ["_hash", key]
    spread = df.select(key, pos, h, value, F.hash(key).alias("_hash")).repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *apart)
    return spread.groupBy(*apart).applyInPandas(run, f"tp long, fp long, fn long, tn long, `{key}` {types[key]}, configuration string, copies array<int>")


def each_copy(counts: DataFrame, repetitions: int) -> DataFrame:
    """A row for every copy that a row of injected_counts stands for: adds event and repetition."""
    each = counts.withColumn("_copy", F.explode("copies"))
    event = F.array(*[F.lit(e) for e in EVENTS])[F.floor(F.col("_copy") / repetitions).cast("int")]
    return each.withColumns({"event": event, "repetition": (F.col("_copy") % repetitions + 1).cast("int")}).drop("copies", "_copy")
