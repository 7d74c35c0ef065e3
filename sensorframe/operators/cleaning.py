"""Windowed-IQR outliers, gap interpolation, and the two in one pass.

All frames are bounded, so each operator is one shuffle by chunk with a halo.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from sensorframe.functions.columns import array_quantile
from sensorframe.operators.filters import zero_to_null
from sensorframe.plans.scan import CHUNK, PART, settle, spread, within
from sensorframe.plans.sizing import attach

KEYS = ["sensor"]
READINGS = ("strain", "temperature")


def window_membership(
    df: DataFrame, window: int = 100, step: int = 20, keys: Sequence[str] = ("sensor",)
) -> DataFrame:
    """One row per (row, full window that contains it); window ``w`` starts at ``w * step``."""
    ends = df.groupBy(*keys).agg((F.max("rn") + 1).alias("_n"))
    first = F.greatest(F.ceil((F.col("rn") - window + 1) / F.lit(step)), F.lit(0))
    last = F.least(F.floor(F.col("rn") / F.lit(step)), F.floor((F.col("_n") - window) / F.lit(step)))
    rows = attach(df, ends, keys, "inner").filter((F.col("_n") >= window) & (first <= last))
    return rows.withColumn("w", F.explode(F.sequence(first.cast("long"), last.cast("long")))).drop("_n")


def _bounds(ordered: Column, k: float) -> Column:
    q1, q3 = array_quantile(ordered, 0.25), array_quantile(ordered, 0.75)
    # rounded so that the last bit of the interpolation cannot decide a comparison
    return F.struct(
        F.round(q1 - k * (q3 - q1), 9).alias("lo"), F.round(q3 + k * (q3 - q1), 9).alias("hi")
    )


def _null_outliers(rows: DataFrame, k: float, window: int, step: int, tail: bool) -> DataFrame:
    """Null the outliers of already chunked rows.

    Rows are packed into blocks that windows are made of, so a window's values are a
    few neighbouring arrays and are sorted once, and a row only meets the tightest
    bounds of the windows over it.
    """
    others = [c for c in rows.columns if c not in ("sensor", PART)]
    grain = math.gcd(window, step)
    per_window, per_step = window // grain, step // grain
    blocks = (
        rows.withColumn("_block", F.floor(F.col("rn") / F.lit(grain)))
        .groupBy("sensor", PART, "_block")
        .agg(
            F.collect_list(F.struct(*others)).alias("_rows"),
            *[F.collect_list(c).alias("_v_" + c) for c in READINGS],
            F.count(F.lit(1)).alias("_size"),
        )
    )
    w = Window.partitionBy("sensor", PART).orderBy("_block")
    ahead = w.rowsBetween(0, per_window - 1)
    blocks = blocks.select(
        "*",
        F.sum("_size").over(ahead).alias("_width"),
        *[F.collect_list("_v_" + c).over(ahead).alias("_w_" + c) for c in READINGS],
    )
    full = (F.col("_width") == window) & (F.col("_block") % per_step == 0)
    place = ["sensor", PART, "_block", "_rows"]
    blocks = blocks.select(
        *place, *[F.when(full, F.sort_array(F.flatten("_w_" + c))).alias("_w_" + c) for c in READINGS]
    )
    blocks = blocks.select(*place, *[_bounds(F.col("_w_" + c), k).alias("_b_" + c) for c in READINGS])
    over = w.rowsBetween(-(per_window - 1), 0)
    blocks = blocks.select(
        "*",
        *[F.max(F.col("_b_" + c)["lo"]).over(over).alias("_lo_" + c) for c in READINGS],
        *[F.min(F.col("_b_" + c)["hi"]).over(over).alias("_hi_" + c) for c in READINGS],
    )
    if tail:  # rows past the last full window meet the bounds of that window
        for c in READINGS:
            for side in ("lo", "hi"):
                blocks = blocks.withColumn(
                    f"_{side}_{c}",
                    F.coalesce(
                        f"_{side}_{c}",
                        F.last(F.col("_b_" + c)[side], ignorenulls=True).over(
                            w.rowsBetween(-(per_window + per_step), 0)
                        ),
                    ),
                )
    flat = blocks.withColumn("_row", F.explode("_rows"))
    cols = []
    for name in others:
        value = F.col("_row")[name]
        if name in READINGS:
            out = (value < F.col("_lo_" + name)) | (value > F.col("_hi_" + name))
            value = F.when(~F.coalesce(out, F.lit(False)), value)
        cols.append(value.alias(name))
    return flat.select("sensor", PART, *cols)


def _aligned(size: int, grain: int) -> int:
    return max(grain, size - size % grain)


def clean_zeros_outliers(
    df: DataFrame, k: float = 3, window: int = 100, step: int = 20, tail: bool = False, size: int = CHUNK
) -> DataFrame:
    """Zeros to NULL, then NULL for values outside ``Q1-k*IQR .. Q3+k*IQR`` of any window.

    Windows of ``window`` rows start every ``step`` rows; only full ones count, so rows
    past the last full window stay untested unless ``tail`` is set.  The windows read
    the values before any outlier is removed.
    """
    grain = math.gcd(window, step)
    size = _aligned(size, grain)
    halo = window + (step if tail else 0)
    rows = spread(zero_to_null(df), KEYS, halo, window, size=size)
    return settle(_null_outliers(rows, k, window, step, tail), size=size).select(*df.columns)


def _fill_gaps(rows: DataFrame, max_len: int) -> DataFrame:
    """Interpolate strain gaps of already chunked rows.

    The rows beside a fillable gap are at most ``max_len + 1`` away.  The halo is at least
    that wide, so a row that is closer than that to the first or last row of its chunk
    has met the start or end of the series.
    """
    reach = max_len + 1
    so_far = within(KEYS).rowsBetween(Window.unboundedPreceding, 0)
    to_come = Window.partitionBy(*KEYS, PART).orderBy(F.desc("rn")).rowsBetween(Window.unboundedPreceding, 0)
    present = F.when(F.col("strain").isNotNull(), F.struct("rn", "strain", "temperature"))
    rows = rows.select(
        "*", F.last(present, ignorenulls=True).over(so_far).alias("_p"), F.first("rn").over(so_far).alias("_first")
    )
    rows = rows.select(
        "*", F.last(present, ignorenulls=True).over(to_come).alias("_q"), F.first("rn").over(to_come).alias("_last")
    )
    p, q, rn = F.col("_p"), F.col("_q"), F.col("rn")
    at_start = p.isNull() & (rn - F.col("_first") < reach)
    at_end = q.isNull() & (F.col("_last") - rn < reach)
    # rows of the gap on either side, this one counted once
    left = F.when(p.isNotNull(), rn - p["rn"]).when(at_start, rn - F.col("_first") + 1)
    right = F.when(q.isNotNull(), q["rn"] - rn).when(at_end, F.col("_last") - rn + 1)
    fillable = F.col("strain").isNull() & (left + right - 1 <= max_len)

    def line(c: str) -> Column:
        slope = p[c] + (q[c] - p[c]) * (rn - p["rn"]) / (q["rn"] - p["rn"])
        filled = F.when(p.isNotNull() & q.isNotNull(), slope).when(p.isNotNull(), p[c]).when(q.isNotNull(), q[c])
        leave = ~F.coalesce(fillable, F.lit(False)) | (p.isNull() & q.isNull())
        return F.when(leave, F.col(c)).otherwise(filled)

    return rows.withColumns({c: line(c) for c in READINGS}).drop("_p", "_q", "_first", "_last")


def interpolate_gaps(df: DataFrame, max_len: int = 20, size: int = CHUNK) -> DataFrame:
    """Fill strain gaps of at most ``max_len`` rows along the straight line between neighbours.

    Both columns are filled inside a strain gap, a present temperature included; a
    missing neighbour temperature makes it missing.  At the start or end of a series
    the one neighbour is carried over; a series without any strain stays as it is.
    """
    if max_len < 1:
        return df
    reach = max_len + 1
    rows = spread(df, KEYS, reach, reach, size=size)
    return settle(_fill_gaps(rows, max_len), size=size).select(*df.columns)


def preprocess(
    df: DataFrame,
    max_len: int = 20,
    k: float = 3,
    window: int = 100,
    step: int = 20,
    size: int = CHUNK,
) -> DataFrame:
    """:func:`clean_zeros_outliers`, then :func:`interpolate_gaps`, in one shuffle."""
    grain = math.gcd(window, step)
    size = _aligned(size, grain)
    reach = max_len + 1
    rows = spread(zero_to_null(df), KEYS, window + reach, window + reach, size=size)
    cleaned = _null_outliers(rows, k, window, step, tail=False)
    return settle(_fill_gaps(cleaned, max_len), size=size).select(*df.columns)
