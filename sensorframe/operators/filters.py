"""Projections, filters and predicates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from sensorframe.functions.columns import format_stamp
from sensorframe.plans.scan import CHUNK, chunk_of, number_rows, settle, spread, within
from sensorframe.plans.sizing import attach, one_row


def zero_to_null(df: DataFrame) -> DataFrame:
    """A strain of exactly zero is a missing reading; temperature is left alone."""
    return df.withColumn("strain", F.nullif("strain", F.lit(0.0)))


def drop_zero_rows(df: DataFrame) -> DataFrame:
    return df.filter(F.coalesce("strain", F.lit(1.0)) != 0)


def time_range(df: DataFrame, lo: str, hi: str, time: str = "time") -> DataFrame:
    """Rows from ``lo`` to ``hi``, both included."""
    kind = dict(df.dtypes)[time]
    return df.filter(F.col(time).between(F.lit(lo).cast(kind), F.lit(hi).cast(kind)))


def grid_slice(grid: DataFrame, start: str, end: str, on_missing: str = "clip") -> DataFrame:
    """Inclusive slice of the time grid between two of its 14-digit stamps.

    A bound that is no grid point means the first/last point (``clip``) or is an error.
    """
    if on_missing not in ("clip", "error"):
        raise ValueError(f"on_missing must be 'clip' or 'error', not {on_missing!r}")
    has_start = F.count(F.when(F.col("stamp") == start, 1)) > 0
    has_end = F.count(F.when(F.col("stamp") == end, 1)) > 0
    if on_missing == "error":
        found = grid.agg(has_start.alias("s"), has_end.alias("e")).first()
        if not (found["s"] and found["e"]):
            raise ValueError(f"grid holds no point {start!r} or {end!r}")
        return grid.filter(F.col("stamp").between(start, end))
    known = one_row(grid, has_start.alias("s"), has_end.alias("e"))
    return grid.filter(
        (~known["s"] | (F.col("stamp") >= start)) & (~known["e"] | (F.col("stamp") <= end))
    )


def trim_rows(
    df: DataFrame, start_idx: int, drop_last: bool = True, size: int = CHUNK
) -> DataFrame:
    """Drop the first ``start_idx`` rows of each sensor and, by default, its last one.

    ``rn`` counts from the first row that is kept.
    """
    kept = df.filter(F.col("rn") >= start_idx)
    if drop_last:
        ends = df.groupBy("sensor").agg(F.max("rn").alias("_last"))
        kept = attach(kept, ends, ["sensor"], "inner").filter(F.col("rn") < F.col("_last")).drop("_last")
    return kept.withColumn("rn", F.col("rn") - start_idx)


def head_rows(df: DataFrame, n: int, order: Sequence[str] = ("sensor", "rn")) -> DataFrame:
    return df.orderBy(*order).limit(n)


def drop_incomplete(df: DataFrame) -> DataFrame:
    """Drop rows with any missing cell, missing profile elements included."""
    for name, kind in df.dtypes:
        if kind.startswith("array"):
            df = df.filter(F.forall(name, lambda x: x.isNotNull()))
    return df.dropna("any")


def keep_coord(header: Column, threshold: float = 0) -> Column:
    """Keep a header unless it has more than one dot or is a number below ``threshold``."""
    dots = F.length(header) - F.length(F.replace(header, F.lit("."), F.lit("")))
    return (dots <= 1) & ~F.coalesce(header.try_cast("double") < threshold, F.lit(False))


def filter_coords(coords: DataFrame, threshold: float = 0) -> DataFrame:
    """Coordinate headers to keep; the column that comes first always stays."""
    return coords.filter((F.col("pos") == 0) | keep_coord(F.col("header"), threshold))


def coerce_numeric(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.withColumns({c: F.col(c).try_cast("double") for c in cols})


def coerce_time(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.withColumns({c: F.try_to_timestamp(F.col(c)) for c in cols})


def keep_loops(
    df: DataFrame,
    names: Sequence[str] | None = None,
    containing: str | None = None,
    lacking: str | None = None,
    starting: str | None = None,
    col: str = "file_name",
) -> DataFrame:
    """Select loops by name list, by a part in any case, by an absent part, by prefix."""
    c = F.col(col)
    if names is not None:
        df = df.filter(c.isin(list(names)))
    if containing is not None:
        df = df.filter(F.contains(F.lower(c), F.lit(containing.lower())))
    if lacking is not None:
        df = df.filter(~c.contains(lacking))
    if starting is not None:
        df = df.filter(c.startswith(starting))
    return df


def warning_rows(matrix: DataFrame, flag: str = "flag", by: Sequence[str] = ("ts",)) -> DataFrame:
    """Rows of those times at which at least one loop is flagged."""
    by = list(by)
    hot = matrix.groupBy(*by).agg(F.sum(flag).alias("_s")).filter("_s > 0").select(*by)
    return matrix.join(hot, by, "left_semi")


def fill_missing(df: DataFrame, value: float = 0, cols: Sequence[str] | None = None) -> DataFrame:
    return df.fillna(value, subset=list(cols) if cols else None)


def merged_path(listing: DataFrame, containing: str | None = None) -> DataFrame:
    r"""``\stamp\file`` as one string, optionally only those that hold a text."""
    path = F.concat(F.lit("\\"), format_stamp(F.col("ts")), F.lit("\\"), F.col("file_name"))
    merged = listing.withColumn("merged", path)
    return merged if containing is None else merged.filter(F.col("merged").contains(containing))


def renumber(df: DataFrame, keys: Sequence[str] = ("sensor",), size: int = CHUNK) -> DataFrame:
    """Close the holes that a row filter left in ``rn``."""
    rows = df.withColumn("_old", F.col("rn")).withColumn("_slot", chunk_of("rn", size))
    return number_rows(rows, keys, ["_old"], "_slot").drop("_old", "_slot")


def with_neighbour(
    df: DataFrame, col: str, out: str, offset: int = 1, keys: Sequence[str] = ("sensor",), size: int = CHUNK
) -> DataFrame:
    """Value of ``col`` ``offset`` rows ahead (behind if negative)."""
    rows = spread(df, keys, max(-offset, 0), max(offset, 0), size=size)
    return settle(rows.withColumn(out, F.lead(col, offset).over(within(keys))), size=size)
