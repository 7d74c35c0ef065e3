"""Ordered computations that never put a whole sensor into one task.

A window partitioned by sensor alone places the longest sensor in a single task.
Here every sensor is cut into *chunks* of consecutive rows: windows run inside a
chunk, and what has to cross a chunk border travels either as a halo of copied
rows (bounded frames) or as one summary row per chunk (running totals, runs).
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F

from sensorframe.plans.sizing import join_same, store

CHUNK = 16_384
PART = "_chunk"


def chunk_of(index: str | Column, size: int = CHUNK) -> Column:
    """Integer quotient; never decreases along ``index``."""
    index = F.col(index) if isinstance(index, str) else index
    return F.call_function("div", index, F.lit(size))


def within(keys: Sequence[str], index: str = "rn") -> WindowSpec:
    """Rows of one chunk in order; pair with :func:`spread` or :func:`chunked`."""
    return Window.partitionBy(*keys, PART).orderBy(index)


def chunked(df: DataFrame, keys: Sequence[str], index: str = "rn", size: int = CHUNK) -> DataFrame:
    return df.withColumn(PART, chunk_of(index, size)).repartition(*keys, PART)


def spread(
    df: DataFrame,
    keys: Sequence[str],
    before: int,
    after: int,
    index: str = "rn",
    size: int = CHUNK,
) -> DataFrame:
    """Chunk ``df``, giving each chunk the ``before``/``after`` rows around it.

    Copies carry a foreign chunk number; :func:`settle` drops them again.
    """
    first = F.greatest(chunk_of(F.col(index) - after, size), F.lit(0).cast("long"))
    last = chunk_of(F.col(index) + before, size)
    return df.withColumn(PART, F.explode(F.sequence(first, last))).repartition(*keys, PART)


def settle(df: DataFrame, index: str = "rn", size: int = CHUNK) -> DataFrame:
    return df.filter(F.col(PART) == chunk_of(index, size)).drop(PART)


def _earlier(keys: Sequence[str], bucket: str) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)


def number_rows(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    bucket: str,
    out: str = "rn",
) -> DataFrame:
    """Zero-based position per key, from per-bucket counts and a sort inside the bucket.

    ``bucket`` must not decrease along ``order``.
    """
    keys = list(keys)
    counts = df.groupBy(*keys, bucket).agg(F.count(F.lit(1)).alias("_n"))
    offsets = counts.select(
        *keys, bucket, F.coalesce(F.sum("_n").over(_earlier(keys, bucket)), F.lit(0)).alias("_offset")
    )
    local = F.row_number().over(Window.partitionBy(*keys, bucket).orderBy(*order))
    return (
        join_same(df.withColumn(out, local), offsets, [*keys, bucket])
        .withColumn(out, (F.col("_offset") + F.col(out) - 1).cast("long"))
        .drop("_offset")
    )


def running_sum(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    bucket: str,
    value: str,
    out: str,
) -> DataFrame:
    """Inclusive running total per key in ``order``, from bucket totals plus a local sum."""
    keys = list(keys)
    totals = df.groupBy(*keys, bucket).agg(F.sum(value).alias("_total"))
    carried = totals.select(
        *keys, bucket, F.coalesce(F.sum("_total").over(_earlier(keys, bucket)), F.lit(0)).alias("_carry")
    )
    w = Window.partitionBy(*keys, bucket).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return (
        join_same(df.withColumn(out, F.sum(value).over(w)), carried, [*keys, bucket])
        .withColumn(out, F.col("_carry") + F.col(out))
        .drop("_carry")
    )


def number_by_time(
    df: DataFrame,
    sensor: str = "sensor",
    time: str = "time",
    ties: Sequence[str] = (),
    out: str = "rn",
    rows_per_bucket: int = CHUNK,
) -> DataFrame:
    """Position of every reading in its sensor's history (ties broken by ``ties``).

    A table of few rows needs no buckets.  Otherwise buckets are time slices sized so
    that evenly spaced data gives at most ``rows_per_bucket`` rows each, whichever sensor
    they belong to.  If the fullest bucket is far above that (bursts), the rows are
    range-sorted and stored instead, which balances any distribution.
    """
    few = 8 * rows_per_bucket
    micros = F.unix_micros(F.col(time).cast("timestamp"))
    n, lo, hi = df.agg(F.count(F.lit(1)), F.min(micros), F.max(micros)).first()
    if n <= few:
        w = Window.partitionBy(sensor).orderBy(time, *ties)
        return df.withColumn(out, (F.row_number().over(w) - 1).cast("long"))
    if lo is None:
        return number_by_sort(df, [sensor], [time, *ties], out, rows_per_bucket)
    width = max(1, -(-(hi - lo + 1) * rows_per_bucket // n))
    slot = F.coalesce(F.floor((micros - lo) / F.lit(width)).cast("long"), F.lit(-1).cast("long"))
    bucketed = df.withColumn("_slot", slot)
    fullest = bucketed.groupBy(sensor, "_slot").count().agg(F.max("count")).first()[0]
    if fullest > few:
        return number_by_sort(df, [sensor], [time, *ties], out, rows_per_bucket)
    return number_rows(bucketed, [sensor], [time, *ties], "_slot", out).drop("_slot")


def number_by_sort(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    out: str = "rn",
    rows_per_part: int = CHUNK,
) -> DataFrame:
    """As :func:`number_rows`, with buckets cut by a range sort over ``keys + order``.

    The sorted rows are stored first: range bounds come from sampling and must be
    the same for the counts and for the rows.
    """
    parts = max(1, -(-df.count() // rows_per_part))
    laid_out = (
        df.repartitionByRange(parts, *keys, *order)
        .sortWithinPartitions(*keys, *order)
        .withColumn("_seq", F.monotonically_increasing_id())
    )
    # the upper 31 bits of the generated id are the partition number
    laid_out = store(laid_out).withColumn("_slot", F.shiftright("_seq", 33))
    return number_rows(laid_out, keys, ["_seq"], "_slot", out).drop("_seq", "_slot")


@dataclass(frozen=True)
class Carry:
    """A per-run aggregate: how to make it from rows and how to merge two parts."""

    name: str
    part: Column
    merge: Column


def first_of(name: str, value: str, index: str = "rn") -> Carry:
    return Carry(name, F.min_by(value, index), F.min_by(name, "start"))


def last_of(name: str, value: str, index: str = "rn") -> Carry:
    return Carry(name, F.max_by(value, index), F.max_by(name, "end"))


def _local_runs(
    df: DataFrame, keys: list[str], flag: Column, index: str, size: int, carries: Sequence[Carry]
) -> DataFrame:
    rows = chunked(df.filter(flag), keys, index, size)
    rows = rows.withColumn("_run", F.col(index) - F.row_number().over(within(keys, index)))
    return rows.groupBy(*keys, PART, "_run").agg(
        F.min(index).alias("start"),
        F.max(index).alias("end"),
        *[c.part.alias(c.name) for c in carries],
    )


def _stitched(local: DataFrame, keys: list[str], size: int) -> DataFrame:
    """Give parts of one run the same ``(_seam, _region)``.

    Only a run that touches a chunk border can continue elsewhere, at most two per
    chunk; those are compared in one window per key, all others inside their chunk.
    """
    edge = (F.col("start") % size == 0) | (F.col("end") % size == size - 1)
    seam = F.when(edge, F.lit(-1).cast("long")).otherwise(F.col(PART))
    w = Window.partitionBy(*keys, "_seam").orderBy("start")
    fresh = F.coalesce(F.lag("end").over(w) + 1 != F.col("start"), F.lit(True))
    return (
        local.withColumn("_seam", seam)
        .withColumn("_fresh", fresh.cast("long"))
        .withColumn("_region", F.sum("_fresh").over(w.rowsBetween(Window.unboundedPreceding, 0)))
        .drop("_fresh")
    )


def runs(
    df: DataFrame,
    keys: Sequence[str],
    flag: Column,
    index: str = "rn",
    size: int = CHUNK,
    carries: Sequence[Carry] = (),
) -> DataFrame:
    """Maximal runs of consecutive ``index`` values on which ``flag`` holds."""
    keys = list(keys)
    local = _local_runs(df, keys, flag, index, size, carries)
    return (
        _stitched(local, keys, size)
        .groupBy(*keys, "_seam", "_region")
        .agg(
            F.min("start").alias("start"),
            F.max("end").alias("end"),
            *[c.merge.alias("_" + c.name) for c in carries],
        )
        .select(
            *keys,
            "start",
            "end",
            (F.col("end") - F.col("start") + 1).alias("length"),
            *[F.col("_" + c.name).alias(c.name) for c in carries],
        )
    )


def mark_runs(
    df: DataFrame,
    keys: Sequence[str],
    flag: Column,
    index: str = "rn",
    size: int = CHUNK,
    sums: dict[str, Column] | None = None,
) -> DataFrame:
    """Add ``run_start``, ``run_end`` and per-run totals ``sums`` to every row (NULL off runs).

    Rows are shuffled once, by chunk.  Totals of runs inside a chunk come from a
    window; runs across borders get theirs from one joined row per chunk.
    The chunk column stays on the result for further chunk-local work.
    """
    keys = list(keys)
    sums = sums or {}
    flag = F.coalesce(flag, F.lit(False))
    rows = chunked(df.withColumn("_on", flag), keys, index, size)
    spot = F.row_number().over(Window.partitionBy(*keys, PART, "_on").orderBy(index))
    rows = rows.withColumn("_run", F.when(F.col("_on"), F.col(index) - spot))
    run = Window.partitionBy(*keys, PART, "_on", "_run")
    names = list(sums)
    rows = rows.select(
        "*",
        F.min(index).over(run).alias("_ls"),
        F.max(index).over(run).alias("_le"),
        *[F.sum(sums[n]).over(run).alias("_l_" + n) for n in names],
    )
    carries = [Carry(n, F.sum(sums[n]), F.sum(n)) for n in names]
    edge = (F.col("start") % size == 0) | (F.col("end") % size == size - 1)
    local = _local_runs(df, keys, flag, index, size, carries).filter(edge)
    region = Window.partitionBy(*keys, "_seam", "_region")
    whole = F.struct(
        F.min("start").over(region).alias("s"),
        F.max("end").over(region).alias("e"),
        *[F.sum(n).over(region).alias(n) for n in names],
    )
    edges = (
        _stitched(local, keys, size)
        .withColumn("_whole", whole)
        .groupBy(*keys, PART)
        .agg(
            F.max(F.when(F.col("start") == F.col(PART) * size, F.col("_whole"))).alias("_head"),
            F.max(F.when(F.col("end") == F.col(PART) * size + size - 1, F.col("_whole"))).alias("_tail"),
        )
    )
    joined = rows.join(edges, [*keys, PART], "left")
    known = F.when(F.col("_ls") == F.col(PART) * size, F.col("_head")).when(
        F.col("_le") == F.col(PART) * size + size - 1, F.col("_tail")
    )

    def pick(field: str, local_name: str) -> Column:
        return F.when(F.col("_on"), F.coalesce(known[field], F.col(local_name)))

    return joined.select(
        *df.columns,
        PART,
        pick("s", "_ls").alias("run_start"),
        pick("e", "_le").alias("run_end"),
        *[pick(n, "_l_" + n).alias(n) for n in names],
    )
