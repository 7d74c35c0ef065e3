"""Writers; all of them write from the tasks that hold the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from sensorframe.functions.columns import format_stamp
from sensorframe.plans.scan import CHUNK, PART, chunk_of


def write_series(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "error", size: int = CHUNK) -> None:
    """One folder per sensor; a long sensor is written by several tasks, in chunks."""
    rows = df.withColumn(PART, chunk_of("rn", size)).repartition("sensor", PART).drop(PART)
    writer = rows.sortWithinPartitions("sensor", "rn").write.mode(mode).partitionBy("sensor")
    if fmt == "csv":
        writer.csv(path, header=True)
    else:
        writer.format(fmt).save(path)


def write_snapshots(raw: DataFrame, root: str, mode: str = "error") -> None:
    """Snapshot files ``<root>/stamp=<stamp>/loop=<loop>/*`` with a line per reading, in order of ``line``."""

    def text(c: str) -> Column:
        return F.coalesce(F.col(c).cast("string"), F.lit(""))

    head = F.concat_ws(", ", text("span"), text("beam"), text("coord"))
    value = F.concat_ws("\t", head, text("strain"), F.lit("0"), F.lit("0"), text("temp"), text("distance"))
    rows = raw.select(format_stamp(F.col("ts")).alias("stamp"), "loop", "line", value.alias("value"))
    rows = rows.repartition("stamp", "loop").sortWithinPartitions("stamp", "loop", "line").drop("line")
    rows.write.mode(mode).partitionBy("stamp", "loop").text(root)


def write_threshold(threshold: DataFrame, path: str, mode: str = "error") -> None:
    """``mean_error`` and ``std_error`` as one JSON line."""
    threshold.select("mean_error", "std_error").coalesce(1).write.mode(mode).json(path)


def write_counts(counts: DataFrame, path: str, mode: str = "error") -> None:
    """``name,count`` lines without a header."""
    counts.select("file_name", "n").write.mode(mode).csv(path, header=False)


def write_distribution(df: DataFrame, path: str, wide: bool = False, mode: str = "error") -> None:
    """Cells ``(ts, coord, strain)`` as parquet, or as a wide matrix CSV with a ``Timestamp`` column.

    The matrix has a column per coordinate, whose list is read first; of repeated cells the smallest is written.
    """
    if not wide:
        df.write.mode(mode).parquet(path)
        return
    matrix = df.withColumn("Timestamp", F.date_format("ts", "yyyy-MM-dd HHmmss"))
    coords = [r[0] for r in df.select("coord").distinct().orderBy("coord").collect()]
    matrix.groupBy("Timestamp").pivot("coord", coords).agg(F.min("strain")).write.mode(mode).csv(path, header=True)
