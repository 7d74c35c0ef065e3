"""Bounded moving frames, sampling gaps, and the linear state filter."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from sensorframe.functions.columns import whole_hours
from sensorframe.operators.filters import renumber, with_neighbour
from sensorframe.plans.scan import CHUNK, PART, chunked, settle, spread, within
from sensorframe.plans.sizing import store

KEYS = ["sensor"]


def rolling_features(df: DataFrame, window: int = 6, size: int = CHUNK) -> DataFrame:
    """Trailing mean, sample variance and deviation of strain; NULL unless all are present."""
    rows = spread(df, KEYS, window - 1, 0, size=size)
    w = within(KEYS).rowsBetween(-(window - 1), 0)
    whole = F.count("strain").over(w) == window
    return settle(
        rows.withColumns(
            {
                "rolling_mean": F.when(whole, F.avg("strain").over(w)),
                "rolling_var": F.when(whole, F.var_samp("strain").over(w)),
                "rolling_std": F.when(whole, F.stddev_samp("strain").over(w)),
            }
        ),
        size=size,
    )


def rolling_mean(
    df: DataFrame,
    col: str = "strain",
    window: int = 6,
    min_periods: int = 1,
    out: str = "rolling_mean",
    keys: Sequence[str] = ("sensor",),
    size: int = CHUNK,
) -> DataFrame:
    """Trailing mean of the values present, NULL with fewer than ``min_periods`` of them."""
    rows = spread(df, keys, window - 1, 0, size=size)
    w = within(keys).rowsBetween(-(window - 1), 0)
    value = F.when(F.count(col).over(w) >= min_periods, F.avg(col).over(w))
    return settle(rows.withColumn(out, value), size=size)


def label_confidence(
    df: DataFrame, col: str = "probability", window: int = 7, keys: Sequence[str] = (), size: int = CHUNK
) -> DataFrame:
    """Trailing mean of the assigned cluster's probability."""
    return rolling_mean(df, col, window, 1, "confidence", keys, size)


def sampling_gaps(df: DataFrame, hours: int = 4, size: int = CHUNK) -> DataFrame:
    """Rows whose next reading is more than ``hours`` whole hours later."""
    rows = with_neighbour(df, "time", "next_time", 1, size=size)
    gap = whole_hours(F.col("time"), F.col("next_time"))
    return rows.withColumn("gap_hours", gap).filter(F.col("gap_hours") > hours)


def _gain_state(p0: np.ndarray, step, start: int) -> np.ndarray:
    """Covariance after ``start`` steps; it settles, so the walk stops once it repeats."""
    p = p0
    for _ in range(start):
        q = step(p)[1]
        if np.array_equal(p, q) or np.allclose(p, q, rtol=0, atol=1e-15):
            return q
        p = q
    return p


def kalman_filter(
    df: DataFrame,
    a,
    h,
    q,
    r,
    x0,
    p0,
    col: str = "strain",
    keep_first: bool = False,
    size: int = CHUNK,
) -> DataFrame:
    """Filtered state of a linear system with constant matrices, per sensor in time order.

    Missing readings are left out.  With ``keep_first`` the state at the first reading
    is ``x0`` as given and updating starts at the second one.

    The gain does not depend on the data, so a step is ``x -> M x + K z`` with known
    ``M`` and ``K``: each chunk is filtered from a zero state, keeping the product of
    its ``M``; chunk ends are then chained, and every row gets the share of the state
    its chunk started from.
    """
    a, h, q, r, p0 = (np.atleast_2d(np.asarray(m, dtype=float)) for m in (a, h, q, r, p0))
    x0 = np.atleast_1d(np.asarray(x0, dtype=float))
    d = len(x0)
    eye = np.eye(d)

    def step(p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        pred = a @ p @ a.T + q
        k = pred @ h.T @ np.linalg.inv(h @ pred @ h.T + r)
        return k, (eye - k @ h) @ pred

    def local(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rn")
        first = int(pdf["rn"].iloc[0])
        p = _gain_state(p0, step, max(first - 1, 0) if keep_first else first)
        x, m = np.zeros(d), np.eye(d)
        xs, ms = [], []
        for rn, z in zip(pdf["rn"].to_numpy(), pdf["_z"].to_numpy()):
            if not (keep_first and rn == 0):
                k, p = step(p)
                t = (eye - k @ h) @ a
                x, m = t @ x + k[:, 0] * z, t @ m
            xs.append(x.copy())
            ms.append(m.ravel().copy())
        return pd.DataFrame(
            {"sensor": pdf["sensor"], PART: pdf[PART], "rn": pdf["rn"], "_x": xs, "_m": ms}
        )

    present = renumber(df.filter(F.col(col).isNotNull()), size=size)
    rows = chunked(present.select("sensor", "rn", F.col(col).cast("double").alias("_z")), KEYS, size=size)
    filtered = rows.groupBy("sensor", PART).applyInPandas(
        local, f"sensor string, {PART} long, rn long, _x array<double>, _m array<double>"
    )
    filtered = store(filtered)  # read for the chunk ends and for the rows

    def chain(pdf: pd.DataFrame) -> pd.DataFrame:  # one row per chunk
        pdf = pdf.sort_values(PART)
        x, starts = x0, []
        for end, m in zip(pdf["_x"], pdf["_m"]):
            starts.append(np.asarray(x))
            x = np.asarray(m).reshape(d, d) @ x + np.asarray(end)
        return pd.DataFrame({"sensor": pdf["sensor"], PART: pdf[PART], "_s": starts})

    ends = filtered.groupBy("sensor", PART).agg(F.max_by(F.struct("_x", "_m"), "rn").alias("e"))
    starts = (
        ends.select("sensor", PART, "e._x", "e._m")
        .groupBy("sensor")
        .applyInPandas(chain, f"sensor string, {PART} long, _s array<double>")
    )
    state = F.transform(
        F.col("_x"),
        lambda x, i: x
        + F.aggregate(
            F.zip_with(F.slice("_m", i * d + 1, F.lit(d)), F.col("_s"), lambda m, s: m * s),
            F.lit(0.0),
            lambda acc, v: acc + v,
        ),
    )
    done = filtered.join(starts, ["sensor", PART]).select("sensor", "rn", state.alias("state"))
    return present.join(done, ["sensor", "rn"])
