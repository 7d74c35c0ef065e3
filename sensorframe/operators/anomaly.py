"""From prepared series to runs of large reconstruction error."""

from __future__ import annotations

import warnings
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from sensorframe.functions.columns import duration_text
from sensorframe.operators.subspace import directions, pack, restored
from sensorframe.plans.scan import CHUNK, PART, first_of, last_of, mark_runs, number_by_sort, runs, settle, spread, within
from sensorframe.plans.sizing import Sized, attach, store

KEYS = ["sensor"]


def chrono_split(df: DataFrame, test_size: float) -> tuple[DataFrame, DataFrame]:
    """First ``floor(n * (1 - test_size))`` rows of each sensor, and the rest renumbered."""
    counts = df.groupBy("sensor").agg((F.max("rn") + 1).alias("_n"))
    rows = attach(df, counts, KEYS, "inner")
    cut = F.floor(F.col("_n") * F.lit(1 - test_size))
    train = rows.filter(F.col("rn") < cut)
    test = rows.filter(F.col("rn") >= cut).withColumn("rn", F.col("rn") - cut)
    return train.drop("_n"), test.drop("_n")


def minmax_scale(
    train: DataFrame, test: DataFrame, features: Sequence[str]
) -> tuple[DataFrame, DataFrame]:
    """Scale each (sensor, feature) to the range it has in ``train``; a constant gives ``x - min``."""
    ranges = Sized(
        train.groupBy("sensor").agg(
            *[F.min(f).alias("_lo_" + f) for f in features], *[F.max(f).alias("_hi_" + f) for f in features]
        )
    )

    def scaled(df: DataFrame) -> DataFrame:
        rows = attach(df, ranges, KEYS)
        for f in features:
            lo, hi = F.col("_lo_" + f), F.col("_hi_" + f)
            rows = rows.withColumn(f, (F.col(f) - lo) / F.coalesce(F.nullif(hi - lo, F.lit(0.0)), F.lit(1.0)))
        return rows.select(*df.columns)

    return scaled(train), scaled(test)


def concat_features(df: DataFrame, features: Sequence[str], sensors: Sequence[str] | None = None) -> DataFrame:
    """One row per position ``rn`` with a column ``"<sensor> - <feature>"`` for each pair.

    Rows missing on one side stay NULL.  ``sensors`` saves the pass that lists them.
    """
    if sensors is None:
        sensors = [r[0] for r in df.select("sensor").distinct().orderBy("sensor").collect()]
    wide = df.groupBy("rn").pivot("sensor", list(sensors)).agg(
        *[F.first(f, ignorenulls=True).alias(f) for f in features]
    )
    single = len(features) == 1
    return wide.select(
        "rn",
        *[
            F.col(f"`{s}`" if single else f"`{s}_{f}`").alias(f"{s} - {f}")
            for s in sensors
            for f in features
        ],
    )


def sequences(
    df: DataFrame,
    length: int,
    features: Sequence[str] = ("strain",),
    label: str = "start",
    drop_last: bool = True,
    keys: Sequence[str] = ("sensor",),
    size: int = CHUNK,
) -> DataFrame:
    """Sliding windows of ``length`` rows as arrays of feature structs.

    A series of n rows gives ``n - length`` sequences; ``drop_last=False`` also gives
    the one that ends at the last row.  ``time`` is that of the first row, or of the
    last with ``label="end"``.
    """
    keys = list(keys)
    need = length + 1 if drop_last else length
    rows = spread(df, keys, 0, length, size=size)
    w = within(keys)
    frame = w.rowsBetween(0, length - 1)
    stamp = F.first("time") if label == "start" else F.last("time")
    rows = rows.select(
        *keys,
        "rn",
        PART,
        stamp.over(frame).alias("time"),
        F.collect_list(F.struct(*features)).over(frame).alias("sequence"),
        F.count(F.lit(1)).over(w.rowsBetween(0, need - 1)).alias("_have"),
    )
    return settle(rows.filter(F.col("_have") == need).drop("_have"), size=size)


def sequence_timestamps(df: DataFrame, length: int, label: str = "start", size: int = CHUNK) -> DataFrame:
    """Sequence number and the time it is labelled with."""
    rows = spread(df, KEYS, 0, length, size=size)
    w = within(KEYS)
    at = F.col("time") if label == "start" else F.lead("time", length - 1).over(w)
    rows = rows.withColumn("_t", at).withColumn("_next", F.lead("rn", length).over(w))
    return settle(rows.filter("_next is not null"), size=size).select("sensor", "rn", F.col("_t").alias("time"))


def sequence_overlap(train: DataFrame, test: DataFrame, col: str = "sequence") -> DataFrame:
    """Distinct sequences present in both frames, compared as 32-bit floats.

    Hashes are compared first, so that only sequences whose hash is in both frames are
    shuffled and compared by value.
    """
    fields = [f.name for f in train.schema[col].dataType.elementType.fields]

    def hashed(df: DataFrame) -> DataFrame:
        flat = F.flatten(F.transform(col, lambda s: F.array(*[s[f] for f in fields]))).cast("array<float>")
        return df.select(flat.alias("values")).withColumn("_h", F.xxhash64("values"))

    a, b = hashed(train), hashed(test)
    shared = Sized(a.select("_h").distinct().join(b.select("_h").distinct(), "_h", "left_semi"))
    a, b = (attach(x, shared, ["_h"], "inner").distinct() for x in (a, b))
    return a.join(b, ["_h", "values"], "left_semi").select("values")


def score_table(actual: DataFrame, reconstructed: DataFrame, keys: Sequence[str] = ("sensor", "rn")) -> DataFrame:
    """Absolute error per position and feature."""
    return actual.join(reconstructed, list(keys)).withColumn(
        "error", F.abs(F.col("actual") - F.col("reconstructed"))
    )


def error_threshold(errors: DataFrame, k: float = 10, col: str = "error") -> DataFrame:
    """Mean, population deviation and ``mean + k * deviation`` of an error column."""
    return errors.agg(
        F.avg(col).alias("mean_error"), F.stddev_pop(col).alias("std_error")
    ).withColumn("threshold", F.col("mean_error") + k * F.col("std_error"))


def rolling_error(errors: DataFrame, n: int = 18, align: str = "start", size: int = CHUNK) -> DataFrame:
    """Mean error of each ``n`` consecutive rows, kept at the first (or last) of them."""
    ahead = align == "start"
    rows = spread(errors, KEYS, 0 if ahead else n - 1, n - 1 if ahead else 0, size=size)
    w = within(KEYS).rowsBetween(*((0, n - 1) if ahead else (-(n - 1), 0)))
    rows = rows.withColumn("rolling_error", F.when(F.count(F.lit(1)).over(w) == n, F.avg("error").over(w)))
    return settle(rows.filter("rolling_error is not null"), size=size)


def anomaly_points(
    errors: DataFrame,
    threshold: float | Column,
    mode: int,
    n: int = 18,
    min_run: int | None = None,
    align: str = "start",
    size: int = CHUNK,
) -> DataFrame:
    """Positions that count as anomalous.

    Mode 1: error above the threshold.  Mode 2: of those, runs of at least ``min_run``
    positions.  Mode 3: the same on the mean error of ``n`` rows.  ``min_run`` is ``n``
    unless given.
    """
    if mode not in (1, 2, 3):
        raise ValueError(f"mode must be 1, 2 or 3, not {mode!r}")
    limit = threshold if isinstance(threshold, Column) else F.lit(threshold)
    min_run = n if min_run is None else min_run
    if mode == 3:
        errors = rolling_error(errors, n, align, size)
    flag = F.col("rolling_error" if mode == 3 else "error") > limit
    if mode == 1:
        return errors.filter(flag)
    marked = mark_runs(errors.withColumn("_flag", flag), KEYS, F.col("_flag"), size=size)
    long_enough = F.col("run_end") - F.col("run_start") + 1 >= min_run
    return marked.filter(long_enough).select(*errors.columns)


def anomaly_table(points: DataFrame, size: int = CHUNK) -> DataFrame:
    """Runs of consecutive anomalous positions with start, end and duration text."""
    times = [first_of("start_time", "time"), last_of("end_time", "time")]
    found = runs(points, KEYS, F.lit(True), size=size, carries=times)
    return found.select(
        "sensor", "start_time", "end_time", duration_text(F.col("start_time"), F.col("end_time")).alias("length")
    )


def feature_cells(df: DataFrame, features: Sequence[str], sensors: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Horizontal concatenation by row position for any number of sensors.

    Returns cells ``(rn, column, x)``, where ``column`` counts sensors by name and features within a sensor, and the header
    ``(sensor, _i)``: column ``_i * len(features) + f`` is feature ``f`` of that sensor.  Missing values are 0.  Sensors that are
    not in a given header are left out.
    """
    if sensors is None:
        sensors = number_by_sort(df.select("sensor").distinct(), [], ["sensor"], "_i").select("sensor", "_i")
    header = Sized(sensors)
    values = F.array(*[F.coalesce(F.col(f).cast("double"), F.lit(0.0)) for f in features])
    rows = attach(df.select("sensor", "rn", values.alias("_x")), header, KEYS, "inner")
    cells = rows.select("rn", "_i", F.posexplode("_x").alias("_f", "x"))
    return cells.select("rn", (F.col("_i") * len(features) + F.col("_f")).cast("int").alias("column"), "x"), header.table


def reconstruction_error(
    train: DataFrame,
    test: DataFrame,
    features: Sequence[str],
    k: int,
    outputs: Sequence[str] = ("strain",),
    tolerance: float = 1e-9,
    passes: int = 100,
) -> DataFrame:
    """Absolute error per output sensor after a linear (principal direction) reconstruction.

    Scales both parts on ``train``, joins the sensors by position (a missing value is 0), learns ``k`` directions
    and scores every test position; columns fit :func:`anomaly_points`.  Directions are iterated to ``tolerance``, see
    :mod:`sensorframe.operators.subspace`; a warning tells if ``passes`` over the data did not reach it.
    """
    columns = ["sensor", "rn", "time", *features]
    train, test = (store(df.select(*[c for c in columns if c in df.columns])) for df in (train, test))
    train, test = minmax_scale(train, test, features)
    cells, header = feature_cells(train, features)
    wide = header.count() * len(features)
    height = train.agg(F.count_distinct("rn")).first()[0]
    known = directions(pack(cells, wide), wide, height, k, tolerance, passes)
    if known.residual > tolerance and known.basis.shape[1] < wide:
        warnings.warn(f"directions reached a residual of {known.residual:.1e} in {known.passes} passes", stacklevel=2)
    blocks = pack(feature_cells(test, features, header)[0], wide)
    cells = restored(blocks, wide, known)
    wanted = F.array(*[F.lit(f) for f in features])[F.col("column") % len(features)]
    named = cells.select(
        "rn",
        F.call_function("div", "column", F.lit(len(features))).alias("_i"),
        wanted.alias("feature"),
        "actual",
        "reconstructed",
        F.abs(F.col("actual") - F.col("reconstructed")).alias("error"),
    ).filter(F.col("feature").isin(list(outputs)))
    scored = attach(named, header.select("_i", "sensor"), ["_i"], "inner").drop("_i")
    scored = scored.select("sensor", "rn", "feature", "actual", "reconstructed", "error")
    return scored.join(test.select("sensor", "rn", "time"), ["sensor", "rn"])
