"""Queries that write derived tables in the file formats and read them back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from sensorframe.functions.columns import format_stamp, grid_floor, r6
from sensorframe.operators import anomaly, explore
from sensorframe.queries import views
from sensorframe.queries.registry import query
from sensorframe.queries.series import SERIES, _series
from sensorframe.queries.views import DISTRIBUTIONS, ERRORS, GRID, LISTING, RAW, READINGS
from sensorframe.session import shared_folder
from sensorframe.sources import readers, writers
from sensorframe.streaming import live


def _new_path(spark, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


@query("write_series", f"WITH {READINGS} SELECT {SERIES} FROM readings")
def _(spark, sf):
    path = _new_path(spark, "series")
    writers.write_series(views.readings(spark, sf), path)
    return _series(spark.read.parquet(path))


@query("read_file_listing", f"WITH {LISTING} SELECT ts, file_name FROM listing")
def _(spark, sf):
    path = _new_path(spark, "listing")
    views.file_listing(spark, sf).select(format_stamp(F.col("ts")), "file_name").write.csv(path)
    return readers.read_file_listing(spark, path).withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@query(
    "read_name_list",
    f"WITH {GRID} SELECT stamp AS name FROM grid",
)
def _(spark, sf):
    path = _new_path(spark, "names")
    stamps = views.grid(spark, sf).select(F.concat(F.lit(" "), "stamp", F.lit(" ")).alias("value"))
    stamps.unionByName(stamps.select(F.concat(F.lit("x"), "value").alias("value"))).write.text(path)
    return readers.read_name_list(spark, path, digits_only=True)


@query(
    "read_requests",
    f"""WITH {RAW} SELECT DISTINCT '20240101000000' AS start, '20240201000000' AS end, loop || '.txt' AS loop,
    span || ',' || beam || ',' || position AS position, '4' AS col FROM raw""",
)
def _(spark, sf):
    path = _new_path(spark, "requests")
    line = F.concat(
        F.lit("20240101000000 20240201000000 "), "loop", F.lit(".txt "), "span", F.lit(", "), "beam", F.lit(", "),
        "position", F.lit(" 4"),
    )
    views.raw_readings(spark, sf).select(line.alias("value")).distinct().write.text(path)
    return readers.read_requests(spark, path)


@query(
    "write_counts",
    f"WITH {LISTING} SELECT file_name, count(*) AS n FROM listing GROUP BY file_name",
)
def _(spark, sf):
    path = _new_path(spark, "counts")
    writers.write_counts(explore.file_counts(views.file_listing(spark, sf)), path)
    return spark.read.schema("file_name string, n bigint").csv(path)


@query(
    "read_threshold",
    f"WITH {ERRORS} SELECT round(avg(error) + 1e-9, 6) AS mean_error, round(stddev_pop(error) + 1e-9, 6) AS std_error FROM errors",
)
def _(spark, sf):
    path = _new_path(spark, "threshold")
    writers.write_threshold(anomaly.error_threshold(views.errors(spark, sf)), path)
    out = readers.read_threshold(spark, path)
    return out.select(r6("mean_error").alias("mean_error"), r6("std_error").alias("std_error"))


@query(
    "read_distribution_csv",
    f"""WITH {DISTRIBUTIONS} SELECT strftime(ts, '%Y-%m-%d %H%M%S') AS timestamp, i, round(strain + 1e-9, 6) + 0.0 AS strain
    FROM cells""",
)
def _(spark, sf):
    path = _new_path(spark, "matrix")
    cells = views.distributions(spark, sf).select("ts", F.posexplode("profile").alias("i", "strain"))
    writers.write_distribution(cells.select("ts", (F.col("i") * 2.5).alias("coord"), "strain"), path, wide=True)
    matrix, _ = readers.read_distribution_csv(spark, path)
    out = matrix.select("timestamp", F.posexplode("profile").alias("i", "strain"))
    return out.select("timestamp", F.col("i").cast("long").alias("i"), r6("strain").alias("strain"))


@query("write_distribution", f"WITH {DISTRIBUTIONS} SELECT ts, coord, round(strain + 1e-9, 6) + 0.0 AS strain FROM cells")
def _(spark, sf):
    path = _new_path(spark, "cells")
    cells = views.distributions(spark, sf).select("ts", F.posexplode("profile").alias("i", "strain"))
    cells = cells.select("ts", (F.col("i") * 2.5).cast("double").alias("coord"), "strain")
    writers.write_distribution(cells, path)
    return spark.read.parquet(path).withColumn("strain", r6("strain"))


_FILED = f"""{RAW}, filed AS (SELECT ts, loop, row_number() OVER (PARTITION BY ts, loop ORDER BY line) - 1 AS line,
    span, beam, coord, strain, temp, CAST(position AS DOUBLE) AS distance, span || ',' || beam || ',' || CAST(coord AS VARCHAR) AS position
    FROM raw)"""


def _snapshot_folder(spark, sf) -> str:
    path = _new_path(spark, "snapshots")
    raw = views.raw_readings(spark, sf).withColumn("distance", F.col("position").cast("double"))
    writers.write_snapshots(raw, path)
    return path


def _naive(df):
    return df.withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@query("read_raw_readings", f"WITH {_FILED} SELECT * FROM filed")
def _(spark, sf):
    return _naive(readers.read_raw_readings(spark, _snapshot_folder(spark, sf)))


@query(
    "read_raw_readings_range",
    f"WITH {_FILED} SELECT * FROM filed WHERE loop IN ('click', 'view') AND ts BETWEEN TIMESTAMP '2024-01-03' AND TIMESTAMP '2024-01-20 08:00:00'",
)
def _(spark, sf):
    path = _snapshot_folder(spark, sf)
    return _naive(readers.read_raw_readings(spark, path, ["click", "view"], "20240103000000", "20240120080000"))


@query("read_distribution_values", f"WITH {_FILED} SELECT ts, line, coord AS value FROM filed WHERE loop = 'error' AND line > 0")
def _(spark, sf):
    path = _new_path(spark, "values")
    raw = views.raw_readings(spark, sf).withColumn("distance", F.lit(0.0))
    # the second token of "N10 1.5, B, 1.5" is a number
    writers.write_snapshots(raw.withColumn("span", F.concat_ws(" ", "span", F.concat(F.col("coord").cast("string"), F.lit(" ")))), path)
    return _naive(readers.read_distribution_values(spark, path, "error"))


@query(
    "read_alarm_texts",
    """SELECT time_bucket(INTERVAL '4 hours', ts) AS ts, string_agg(event_type || ';' || user_id, ' ' ORDER BY event_id) || chr(10) AS text
    FROM events GROUP BY 1""",
)
def _(spark, sf):
    path = _new_path(spark, "alarms")
    events = views.table(spark, sf, "events").withColumn("slot", grid_floor(F.col("ts")))
    entry = F.struct("event_id", F.concat_ws(";", "event_type", F.col("user_id").cast("string")).alias("t"))
    texts = events.groupBy("slot").agg(F.array_join(F.transform(F.sort_array(F.collect_list(entry)), lambda e: e["t"]), " ").alias("value"))
    texts.select(format_stamp(F.col("slot")).alias("stamp"), "value").write.partitionBy("stamp").text(path)
    return _naive(readers.read_alarm_texts(spark, path, "*.txt"))


@query("stream_readings", f"WITH {_FILED} SELECT * FROM filed")
def _(spark, sf):
    return _naive(live.run_available(live.stream_readings(spark, _snapshot_folder(spark, sf))))


@query("read_series_csv", f"WITH {READINGS} SELECT {SERIES}, strftime(time, '%Y%m%d%H%M%S') AS time_index FROM readings")
def _(spark, sf):
    path = _new_path(spark, "csv")
    rows = views.readings(spark, sf).select(
        "sensor", "rn", format_stamp(F.col("time")).alias("Time_index"), F.col("time").cast("string").alias("Time"),
        F.col("strain").alias("Strain"), F.col("temperature").alias("Temperature"),
    )
    files = rows.repartition("sensor").sortWithinPartitions("sensor", "rn").drop("rn")
    files.write.partitionBy("sensor").csv(path, header=True)
    back = readers.read_series_csv(spark, path)
    return _series(back.withColumn("time", F.col("time").cast("timestamp_ntz"))).join(
        back.select("sensor", "rn", "time_index"), ["sensor", "rn"]
    )
