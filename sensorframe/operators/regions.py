"""Runs of missing or present strain, and corrections applied per run."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, WindowSpec, functions as F

from sensorframe.plans.scan import (
    CHUNK,
    PART,
    chunk_of,
    first_of,
    last_of,
    mark_runs,
    number_rows,
    running_sum,
    runs,
    settle,
    spread,
    within,
)
from sensorframe.plans.sizing import Sized, attach, store

KEYS = ["sensor"]
FEW_CHUNKS = 8  # tables of at most this many chunks of rows are ordered in one window


def _regions(df: DataFrame, missing: bool, min_len: int, size: int) -> DataFrame:
    flag = F.col("strain").isNull() if missing else F.col("strain").isNotNull()
    times = [first_of("start_time", "time"), last_of("end_time", "time")]
    return (
        runs(df, KEYS, flag, size=size, carries=times)
        .filter(F.col("length") >= min_len)
        .select(
            "sensor",
            F.col("start").alias("start_rn"),
            F.col("end").alias("end_rn"),
            "start_time",
            "end_time",
            "length",
        )
    )


def gap_regions(df: DataFrame, min_len: int = 1, size: int = CHUNK) -> DataFrame:
    """Maximal runs of missing strain with at least ``min_len`` rows."""
    return _regions(df, True, min_len, size)


def valid_regions(df: DataFrame, min_len: int = 100, size: int = CHUNK) -> DataFrame:
    """Maximal runs of present strain with at least ``min_len`` rows."""
    return _regions(df, False, min_len, size)


def longest_regions(regions: DataFrame, k: int | None = None) -> DataFrame:
    """Longest first, equal lengths by start."""
    ordered = regions.orderBy(F.desc("length"), "start_rn", "sensor")
    return ordered if k is None else ordered.limit(k)


def order_by_time(df: DataFrame, time: str = "time") -> DataFrame:
    """Rows in time order; equal times are ordered by the other columns."""
    return df.orderBy(time, *[F.col(f"`{c}`") for c, kind in df.dtypes if c != time and not kind.startswith("map")])


def overlapping_regions(regions: DataFrame, min_span: int = 100, size: int = CHUNK) -> DataFrame:
    """Intervals covered by a region of every sensor, if ``end - start >= min_span``.

    A sweep over region borders: +1 where one starts, -1 behind its end; the running
    count reaches the number of sensors exactly on the common intervals.
    """
    steps = regions.select(
        "sensor",
        F.explode(
            F.array(
                F.struct(F.col("start_rn").alias("pos"), F.lit(1).alias("d")),
                F.struct((F.col("end_rn") + 1).alias("pos"), F.lit(-1).alias("d")),
            )
        ).alias("e"),
    ).select("sensor", "e.*")
    steps = Sized(steps)
    sensors = steps.table.agg(F.count_distinct("sensor").alias("n")).scalar()
    borders = steps.table.groupBy("pos").agg(F.sum("d").alias("d"))
    if steps.rows <= FEW_CHUNKS * size:
        w = Window.orderBy("pos")
        nxt = borders.select(
            "pos",
            F.sum("d").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("depth"),
            F.lead("pos").over(w).alias("_next"),
        )
    else:
        borders = borders.withColumn("_slot", chunk_of("pos", size))
        depth = running_sum(borders, [], "pos", "_slot", "d", "depth")
        ordered = number_rows(depth, [], ["pos"], "_slot", "i")
        nxt = spread(ordered, [], 0, 1, index="i", size=size)
        nxt = settle(nxt.withColumn("_next", F.lead("pos").over(within([], "i"))), "i", size)
    return (
        nxt.filter(F.col("depth") == sensors)
        .select(F.col("pos").alias("start_rn"), (F.col("_next") - 1).alias("end_rn"))
        .filter(F.col("end_rn") - F.col("start_rn") >= min_span)
    )


def overlap_pair(left: DataFrame, right: DataFrame) -> DataFrame:
    """Intersections of two region lists of one pair of sensors (no two of a list overlap)."""
    both = left.withColumn("sensor", F.lit("left")).unionByName(right.withColumn("sensor", F.lit("right")))
    return overlapping_regions(both, 0)


def center_regions(df: DataFrame, size: int = CHUNK) -> DataFrame:
    """Subtract the mean of each run of present strain from its rows."""
    sums = {"_total": F.col("strain"), "_count": F.when(F.col("strain").isNotNull(), 1).otherwise(0)}
    marked = mark_runs(df, KEYS, F.col("strain").isNotNull(), size=size, sums=sums)
    centred = F.col("strain") - F.col("_total") / F.col("_count")
    return marked.withColumn("strain", centred).select(*df.columns)


def region_shifts(
    df: DataFrame,
    k: float = 4.6,
    n_prev: int = 20,
    n_curr: int = 20,
    min_region: int = 5,
    size: int = CHUNK,
) -> DataFrame:
    """Accumulated shift per run of present strain (see :func:`rebaseline_regions`).

    Neighbouring runs carry the same accumulated shift when they are compared, so it
    cancels out: each jump follows from the raw data and the shift is a running sum.
    """
    return _shifts_of(mark_runs(df, KEYS, F.col("strain").isNotNull(), size=size), k, n_prev, n_curr, min_region, size)


def _shifts_of(
    marked: DataFrame, k: float, n_prev: int, n_curr: int, min_region: int, size: int
) -> DataFrame:
    head = F.col("rn") < F.col("run_start") + n_curr
    tail = F.col("rn") > F.col("run_end") - n_prev
    stats = (
        marked.filter(F.col("run_start").isNotNull() & (head | tail))
        .groupBy("sensor", "run_start", "run_end")
        .agg(
            F.avg(F.when(head, F.col("strain"))).alias("head"),
            F.avg(F.when(tail, F.col("strain"))).alias("tail"),
            F.stddev_samp(F.when(tail, F.col("strain"))).alias("noise"),
        )
        .withColumn("_slot", chunk_of("run_start", size))
    )
    stats = Sized(stats)

    def with_delta(rows: DataFrame, w: WindowSpec) -> DataFrame:
        before = F.lag(F.struct("run_start", "run_end", "tail", "noise"), 1).over(w)
        rows = rows.withColumn("_b", before).withColumn("_noise2", F.lag("noise", 2).over(w))
        short = (F.col("_b.run_end") - F.col("_b.run_start") + 1 < min_region) & (F.col("i") > 1)
        noise = F.when(short, F.col("_noise2")).otherwise(F.col("_b.noise"))
        mean, head = F.col("_b.tail"), F.col("head")
        jump = (head < mean - k * noise) | (head > mean + k * noise)
        return rows.withColumn("delta", F.when(jump, mean - head).otherwise(0.0))

    if stats.rows <= FEW_CHUNKS * size:
        w = Window.partitionBy(*KEYS).orderBy("run_start")
        rows = with_delta(stats.table.withColumn("i", F.row_number().over(w) - 1), w)
        shifted = rows.withColumn("shift", F.sum("delta").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    else:
        ordered = number_rows(stats.table, KEYS, ["run_start"], "_slot", "i")
        rows = with_delta(spread(ordered, KEYS, 2, 0, index="i", size=size), within(KEYS, "i"))
        shifted = running_sum(store(settle(rows, "i", size)), KEYS, "i", "_slot", "delta", "shift")
    return shifted.select("sensor", "run_start", "run_end", "delta", "shift")


def rebaseline_regions(
    df: DataFrame,
    k: float = 4.6,
    n_prev: int = 20,
    n_curr: int = 20,
    min_region: int = 5,
    size: int = CHUNK,
) -> DataFrame:
    """Move each run so that its head meets the tail of the run before, if it jumped.

    A jump is a head mean (first ``n_curr`` points) further than ``k`` standard deviations
    from the tail mean (last ``n_prev`` points) of the run before.  If that run is shorter
    than ``min_region``, the deviation of the run before it is used; a single point has
    no deviation and causes no shift.  Shifts add up along the series.
    """
    # stored, because the shifts are learnt from the marked rows and then applied to them
    marked = store(mark_runs(df, KEYS, F.col("strain").isNotNull(), size=size))
    shifts = _shifts_of(marked, k, n_prev, n_curr, min_region, size)
    # one row per chunk a run lies in, so that a long run is joined in pieces
    pieces = shifts.select(
        "sensor",
        "run_start",
        "shift",
        F.explode(F.sequence(chunk_of("run_start", size), chunk_of("run_end", size))).alias(PART),
    )
    moved = marked.join(pieces, ["sensor", PART, "run_start"], "left")
    return moved.withColumn("strain", F.col("strain") + F.coalesce("shift", F.lit(0.0))).select(*df.columns)


def apply_shifts(df: DataFrame, shifts: DataFrame, size: int = CHUNK) -> DataFrame:
    """Add ``strain[ref_rn] - strain[start_rn]`` to rows ``start_rn..end_rn`` (inclusive).

    Several spans of one sensor are independent of each other.  The spans are cut at
    chunk borders, so the range match is an equality join on ``(sensor, chunk)``.
    """
    ends = shifts.select(
        "sensor",
        "start_rn",
        "end_rn",
        F.explode(F.array(F.col("ref_rn"), F.col("start_rn"))).alias("rn"),
        "ref_rn",
    )
    points = attach(df.select("sensor", "rn", "strain"), ends, ["sensor", "rn"], "inner")
    by_span = points.groupBy("sensor", "start_rn", "end_rn").agg(
        (
            F.max(F.when(F.col("rn") == F.col("ref_rn"), F.col("strain")))
            - F.max(F.when(F.col("rn") == F.col("start_rn"), F.col("strain")))
        ).alias("_shift")
    )
    pieces = by_span.withColumn(
        PART, F.explode(F.sequence(chunk_of("start_rn", size), chunk_of("end_rn", size)))
    )
    per_chunk = pieces.groupBy("sensor", PART).agg(
        F.collect_list(F.struct("start_rn", "end_rn", "_shift")).alias("_spans")
    )
    rows = attach(df.withColumn(PART, chunk_of("rn", size)), per_chunk, ["sensor", PART])
    total = F.aggregate(
        F.filter("_spans", lambda s: F.col("rn").between(s["start_rn"], s["end_rn"])),
        F.lit(0.0),
        lambda acc, s: acc + s["_shift"],
    )
    return rows.withColumn("strain", F.col("strain") + F.coalesce(total, F.lit(0.0))).select(*df.columns)


def merge_segment(original: DataFrame, shifted: DataFrame, spans: DataFrame, size: int = CHUNK) -> DataFrame:
    """The original with only the rows inside ``spans`` taken from ``shifted``."""
    pieces = spans.withColumn(
        PART, F.explode(F.sequence(chunk_of("start_rn", size), chunk_of("end_rn", size)))
    )
    per_chunk = pieces.groupBy("sensor", PART).agg(
        F.collect_list(F.struct("start_rn", "end_rn")).alias("_spans")
    )
    marked = attach(shifted.withColumn(PART, chunk_of("rn", size)), per_chunk, ["sensor", PART], "inner")
    inside = marked.filter(
        F.exists("_spans", lambda s: F.col("rn").between(s["start_rn"], s["end_rn"]))
    ).select("sensor", "rn", F.col("strain").alias("_strain"), F.lit(True).alias("_hit"))
    merged = original.join(inside, ["sensor", "rn"], "left")
    value = F.when(F.col("_hit"), F.col("_strain")).otherwise(F.col("strain"))
    return merged.withColumn("strain", value).select(*original.columns)
