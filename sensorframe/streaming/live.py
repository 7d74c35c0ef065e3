"""Operators over readings that keep arriving."""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from sensorframe.operators.mixture import Mixture, dpgmm_label
from sensorframe.plans.sizing import store
from sensorframe.session import shared_folder
from sensorframe.sources.readers import _snapshot_files, parse_snapshots


def stream_readings(
    spark: SparkSession, root: str, loops: Sequence[str] | None = None, files_per_trigger: int | None = None
) -> DataFrame:
    """Snapshot folders as they land."""
    reader = spark.readStream
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return parse_snapshots(_snapshot_files(reader, root, loops))


def stream_grid_means(
    df: DataFrame, width: str = "4 hours", slide: str | None = None, delay: str = "1 day", time: str = "time"
) -> DataFrame:
    """Mean strain and row count per sensor and window; rows later than ``delay`` are dropped.

    Hot sensors cost one partial row per task and window, not one per reading.
    """
    window = F.window(time, width, slide) if slide else F.window(time, width)
    grouped = df.withWatermark(time, delay).groupBy("sensor", window.alias("w"))
    means = grouped.agg(F.avg("strain").alias("strain"), F.count(F.lit(1)).alias("n"))
    return means.select("sensor", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "strain", "n")


def stream_activity_sessions(
    df: DataFrame, gap: str = "4 hours", delay: str = "1 day", time: str = "time"
) -> DataFrame:
    """Periods of activity per sensor that are separated by more than ``gap``.

    Sessions are merged inside each task before the shuffle, so a busy sensor costs one row per task and session.
    """
    df.sparkSession.conf.set("spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition", "true")
    grouped = df.withWatermark(time, delay).groupBy("sensor", F.session_window(time, gap).alias("w"))
    sessions = grouped.agg(F.count(F.lit(1)).alias("n"))
    return sessions.select("sensor", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


_SEGMENT = "sensor string, start_rn long, end_rn long, start_us long, end_ms long, hot boolean"
#: rows of a sensor that share one state
CHUNK = 4096


def _segments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Stretches of consecutive rows with the same flag, so that few rows reach the state."""
    for pdf in batches:
        if not len(pdf):
            continue
        pdf = pdf.sort_values(["sensor", "rn"], ignore_index=True)
        new = (
            (pdf["sensor"] != pdf["sensor"].shift())
            | (pdf["rn"] != pdf["rn"].shift() + 1)
            | (pdf["hot"] != pdf["hot"].shift())
        ).cumsum()
        found = pdf.groupby(new, sort=False).agg(
            sensor=("sensor", "first"),
            start_rn=("rn", "first"),
            end_rn=("rn", "last"),
            start_us=("us", "min"),
            end_ms=("us", "max"),
            hot=("hot", "first"),
        )
        found["end_ms"] //= 1000
        yield found


_COLD, _HOT = 1, 2
#: chunk of the rows that belong to no sensor or have no number
_NOWHERE = -1


def _starts(known: np.ndarray, settled: int, min_run: int, size: int) -> set[int]:
    """Offsets of the runs that certainly begin in the chunk and reach ``min_run`` rows.

    ``known`` covers the row before the chunk, the chunk and ``min_run - 1`` rows after it; rows up to offset ``settled``
    that have not come count as cold.
    """
    cold = known == _COLD
    cold[: settled + 1] |= known[: settled + 1] == 0
    hot = np.append(0, np.cumsum(known == _HOT))
    whole = hot[min_run + 1 :] - hot[1:-min_run] == min_run  # for offsets 1 to size
    return set((np.flatnonzero(whole[:size] & cold[:size]) + 1).tolist())


def _follow(min_run: int, size: int):
    def follow(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        sensor, chunk = key
        if chunk == _NOWHERE:
            return
        origin = int(chunk) * size - 1
        passed = state.getCurrentWatermarkMs()
        if state.exists:
            held, settled, first, ms, last, until = state.get
            known, times, ends = np.frombuffer(held, np.uint8).copy(), dict(zip(first, ms)), dict(zip(last, until))
        else:
            known, settled, times, ends = np.zeros(size + min_run, np.uint8), -1, {}, {}
            if chunk == 0:
                known[0] = _COLD  # no row comes before the first one
        before = _starts(known, settled, min_run, size)
        for pdf in parts:
            for s in pdf.itertuples():
                if s.end_ms < passed:
                    continue
                at, end = int(s.start_rn) - origin, int(s.end_rn) - origin
                known[at : end + 1] = np.maximum(known[at : end + 1], _HOT if s.hot else _COLD)
                ends[end] = max(ends.get(end, 0), int(s.end_ms))
                if s.hot and s.begins:
                    times[at] = min(times.get(at, int(s.start_us)), int(s.start_us))
        settled = max([int(settled), *(end for end, ms in ends.items() if ms < passed)])
        now = _starts(known, settled, min_run, size)
        found = [(sensor, origin + i, times[i], origin + i + min_run - 1) for i in sorted(now - before)]
        if known.all() or settled == len(known) - 1:
            if state.exists:
                state.remove()
        elif known.any():
            times = {i: t for i, t in times.items() if known[i - 1] != _HOT and i not in now}
            ends = {end: ms for end, ms in ends.items() if end > settled}
            columns = (list(times), list(times.values()), list(ends), list(ends.values()))
            state.update((bytearray(known.tobytes()), int(settled), *columns))
            if ends:  # wake up when the watermark has passed the first stretch that may still be amended
                state.setTimeoutTimestamp(max(min(ends.values()), passed) + 1)
        yield pd.DataFrame(found, columns=["sensor", "start_rn", "start_us", "alert_rn"])

    return follow


def stream_anomaly_runs(
    df: DataFrame, threshold: float, min_run: int = 18, delay: str = "1 day", size: int = CHUNK
) -> DataFrame:
    """One alert per run of errors above ``threshold`` that reaches ``min_run`` rows.

    Rows ``(sensor, rn, time, error)`` come in any order, within ``delay`` of event time; ``rn`` counts from 0 in the order
    of time (rows without a sensor or number only move the watermark).  An alert is given when the row before the run is known, or cannot come any more, so late rows never
    split or shift a run.  Missing numbers count as rows below the threshold once the watermark has passed them.

    State is kept per sensor and chunk of ``size`` rows: a run belongs to the chunk it begins in, and stretches of rows
    also go to chunks whose runs they may prolong.  So a busy sensor is spread over tasks, and the state of a chunk (one byte
    a row) goes when all its rows are there.
    """
    time = F.col("time").cast("timestamp")
    hot = F.coalesce(F.col("error") > threshold, F.lit(False)).alias("hot")
    flagged = df.select("sensor", "rn", F.unix_micros(time).alias("us"), hot)
    stretches = flagged.mapInPandas(_segments, _SEGMENT)
    until = F.least(F.timestamp_millis("end_ms"), F.lit("2262-01-01").cast("timestamp"))  # pandas holds no later time
    stretches = stretches.withColumn("until", until).withWatermark("until", delay)
    first = F.greatest(F.floor((F.col("start_rn") - (min_run - 1)) / size), F.lit(0))
    last = F.floor((F.col("end_rn") + 1) / size)
    # a filter would be moved below the watermark, where rows without a number still have to count
    usable = F.col("sensor").isNotNull() & (F.col("start_rn") >= 0)
    chunks = F.when(usable, F.sequence(first, last)).otherwise(F.array(F.lit(_NOWHERE).cast("long")))
    spread = stretches.withColumn("chunk", F.explode(chunks))
    low, high = F.col("chunk") * size - 1, (F.col("chunk") + 1) * size + min_run - 2
    cut = spread.withColumn("begins", F.col("start_rn") > low).withColumns(
        {"start_rn": F.greatest("start_rn", low), "end_rn": F.least("end_rn", high)}
    )
    alerts = cut.groupBy("sensor", "chunk").applyInPandasWithState(
        _follow(min_run, size),
        "sensor string, start_rn long, start_us long, alert_rn long",
        "known binary, settled long, first array<long>, ms array<long>, last array<long>, until array<long>",
        "append",
        GroupStateTimeout.EventTimeTimeout,
    )
    return alerts.select("sensor", "start_rn", F.timestamp_micros("start_us").alias("start_time"), "alert_rn")


def stream_label(df: DataFrame, model: Mixture, features: str = "scores") -> DataFrame:
    """Label arriving vectors with a fitted mixture (its size is set by the number of components)."""
    return dpgmm_label(df, model, features)


def closing(stream: DataFrame, time: str = "time") -> DataFrame:
    """A bounded replay followed by one row far ahead in time, which closes every window of the replay.

    Apply it before the watermark.  The window of that row stays open, so it is never emitted.
    """
    spark = stream.sparkSession
    ahead = F.lit("9000-01-01 00:00:00")
    end = store(
        spark.range(1).select(
            *[(ahead if f.name == time else F.lit(None)).cast(f.dataType).alias(f.name) for f in stream.schema]
        )
    )
    return stream.unionByName(spark.readStream.schema(end.schema).parquet(end.inputFiles()[0].rsplit("/", 1)[0]))


def run_available(stream: DataFrame, path: str | None = None, mode: str = "append") -> DataFrame:
    """Process everything that is there, append it to a table and return the table.

    Progress and output lie in the shared folder, so a restarted query carries on.
    """
    spark = stream.sparkSession
    path = path or f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    query = (
        stream.writeStream.format("parquet")
        .outputMode(mode)
        .option("path", f"{path}/rows")
        .option("checkpointLocation", f"{path}/progress")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/rows")
