"""Extraction onto the time grid, file presence, alignment, supports, coordinates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from sensorframe.functions.columns import first_number, format_stamp, grid_floor, parse_stamp, strip_blanks
from sensorframe.plans.sizing import attach

STEP = "4 hours"


def time_grid(spark, start: str, stop: str, step: str = STEP) -> DataFrame:
    """Every ``step`` from ``start`` to ``stop`` inclusive, with its 14-digit stamp."""
    grid = F.sequence(
        F.lit(start).cast("timestamp"), F.lit(stop).cast("timestamp"), F.expr(f"interval {step}")
    )
    return spark.range(1).select(F.explode(grid).alias("ts")).withColumn("stamp", format_stamp(F.col("ts")))


def grid_over(df: DataFrame, time: str = "time", step_hours: int = 4) -> DataFrame:
    """The grid that covers the times of ``df``, from the step its first time lies in."""
    kind = dict(df.dtypes)[time]
    ends = df.agg(
        grid_floor(F.min(time), step_hours).cast(kind).alias("a"), F.max(time).alias("b")
    )
    grid = F.sequence("a", "b", F.expr(f"interval {step_hours} hours"))
    return ends.select(F.explode(grid).alias("ts")).withColumn("stamp", format_stamp(F.col("ts")))


def position_of(span: str = "span", beam: str = "beam", coord: str = "coord"):
    """Position text as requests write it: ``span,beam,coord`` without blanks."""
    return strip_blanks(F.concat_ws(",", F.col(span), F.col(beam), F.col(coord).cast("string")))


def extract_series(
    raw: DataFrame, requests: DataFrame, start: str, stop: str, step: str = STEP
) -> DataFrame:
    """Strain and temperature of every requested (loop, position) at every grid time.

    A request may narrow the grid by its 14-digit ``start``/``end``; a bound that is no
    grid stamp means the grid's own end.  Missing files or positions give NULL, the first
    line wins where a position is repeated.  Output: one row per request and grid time.
    """
    lo, hi = F.lit(start).cast("timestamp"), F.lit(stop).cast("timestamp")
    every = F.sequence(lo, hi, F.expr(f"interval {step}"))
    asked = requests.select("loop", "position", "start", "end").distinct()
    wanted = (
        asked.withColumn("_grid", every)
        .withColumn("_a", F.coalesce(F.when(F.array_contains("_grid", parse_stamp(F.col("start"))), parse_stamp(F.col("start"))), lo))
        .withColumn("_b", F.coalesce(F.when(F.array_contains("_grid", parse_stamp(F.col("end"))), parse_stamp(F.col("end"))), hi))
        .select("loop", "position", F.explode(F.filter("_grid", lambda t: t.between(F.col("_a"), F.col("_b")))).alias("ts"))
        .withColumn("ts", F.col("ts").cast(dict(raw.dtypes)["ts"]))
    )
    pairs = asked.select("loop", "position").distinct()
    first_lines = (
        attach(raw, pairs, ["loop", "position"], "inner")
        .groupBy("ts", "loop", "position")
        .agg(F.min_by(F.struct("strain", "temp"), "line").alias("_r"))
    )
    return wanted.join(first_lines, ["ts", "loop", "position"], "left").select(
        "loop",
        "position",
        format_stamp(F.col("ts")).alias("time_index"),
        F.col("ts").alias("time"),
        F.col("_r.strain").alias("strain"),
        F.col("_r.temp").alias("temperature"),
    )


def files_present(grid: DataFrame, listing: DataFrame, name: str) -> DataFrame:
    return grid.join(listing.filter(F.col("file_name") == name).select("ts").distinct(), "ts", "left_semi")


def files_missing(grid: DataFrame, listing: DataFrame, name: str) -> DataFrame:
    return grid.join(listing.filter(F.col("file_name") == name).select("ts").distinct(), "ts", "left_anti")


def align_on_time(df: DataFrame, sensors: Sequence[str] | None = None, col: str = "strain") -> DataFrame:
    """One row per time with a column per sensor (full outer alignment).

    The table is as wide as there are sensors; without a list their names are read first.
    """
    if sensors is None:
        sensors = [r[0] for r in df.select("sensor").distinct().orderBy("sensor").collect()]
    return df.groupBy("time").pivot("sensor", list(sensors)).agg(F.min_by(col, "rn"))


def with_supports(points: DataFrame, supports: DataFrame) -> DataFrame:
    """Name each support at the sampled coordinate nearest to it (the lower one on a tie)."""
    places = supports.select("beam", "support", F.col("coord").alias("_at"))
    sampled = points.select("beam", "coord").distinct()
    nearest = (
        sampled.join(places, "beam")
        .groupBy("beam", "support")
        .agg(F.min_by("coord", F.struct(F.abs(F.col("coord") - F.col("_at")), "coord")).alias("coord"))
        .groupBy("beam", "coord")
        .agg(F.array_join(F.sort_array(F.collect_list("support")), ",").alias("support"))
    )
    return attach(points, nearest, ["beam", "coord"])


def beam_coordinates(raw: DataFrame, keys: Sequence[str] = ("ts", "loop")) -> DataFrame:
    """Put the spans of a snapshot end to end.

    Spans come in the order of the first number in their name, those without one last;
    each begins where the one before it ended.
    """
    keys = list(keys)
    extents = raw.groupBy(*keys, "span").agg(F.min("coord").alias("_min"), F.max("coord").alias("_max"))
    order = Window.partitionBy(*keys).orderBy(first_number(F.col("span")).asc_nulls_last(), "span")
    offset = F.sum(F.col("_max") - F.col("_min")).over(order.rowsBetween(Window.unboundedPreceding, -1))
    placed = extents.select(*keys, "span", (F.coalesce(offset, F.lit(0.0)) - F.col("_min")).alias("_by"))
    return (
        raw.join(placed, [*keys, "span"], "left")
        .withColumn("beam_coord", F.col("coord") + F.col("_by"))
        .drop("_by")
    )


def distinct_loops(listing: DataFrame) -> DataFrame:
    return listing.select("file_name").distinct()


def first_per_time(listing: DataFrame) -> DataFrame:
    """One row per time: the least file name."""
    return listing.groupBy("ts").agg(F.min("file_name").alias("file_name"))


def append_rows(*parts: DataFrame) -> DataFrame:
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    return whole


def rows_except(df: DataFrame, drop: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.join(drop.select(*keys).distinct(), list(keys), "left_anti")


def sample_times(grid: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """``n`` distinct grid times in an order fixed by ``seed``."""
    shuffled = F.md5(F.concat(F.col("stamp"), F.lit(str(seed))))
    return grid.select("ts", "stamp").distinct().orderBy(shuffled).limit(n)
