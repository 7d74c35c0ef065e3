"""Streams fed file by file."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from sensorframe.operators import mixture
from sensorframe.streaming import live

DAY = dt.datetime(2020, 1, 1)
LAYOUT = "sensor string, rn bigint, time timestamp, strain double, error double"


def feed(spark, tmp_path, batches):
    for i, rows in enumerate(batches):
        df = spark.createDataFrame(rows, LAYOUT).coalesce(1)
        df.write.mode("append").parquet(str(tmp_path / "in" / f"part={i}"))
    reader = spark.readStream.schema(LAYOUT + ", part int").option("maxFilesPerTrigger", 1).option("latestFirst", "false")
    return reader.parquet(str(tmp_path / "in")).drop("part")


def at(hours, strain=1.0, rn=0, error=0.0, sensor="a"):
    return (sensor, rn, DAY + dt.timedelta(hours=hours), strain, error)


def test_late_rows_are_dropped(spark, tmp_path):
    # a watermark takes effect for late rows one batch after it was reached
    batches = [[at(1, 1.0), at(2, 3.0)], [at(60, 5.0)], [at(60, 6.0)], [at(3, 100.0), at(61, 7.0)], [at(200, 1.0)]]
    out = live.run_available(live.stream_grid_means(feed(spark, tmp_path, batches)), str(tmp_path / "out"))
    got = {r["start"]: (r["strain"], r["n"]) for r in out.collect()}
    assert got == {DAY: (2.0, 2), DAY + dt.timedelta(hours=60): (6.0, 3)}


def test_sessions(spark, tmp_path):
    batches = [[at(0), at(3), at(20)], [at(22), at(40)], [at(300)]]
    out = live.run_available(live.stream_activity_sessions(feed(spark, tmp_path, batches)), str(tmp_path / "out"))
    got = sorted((r["start"], r["n"]) for r in out.collect())
    assert got == [(DAY, 2), (DAY + dt.timedelta(hours=20), 2), (DAY + dt.timedelta(hours=40), 1)]


def test_runs_across_batches(spark, tmp_path):
    hot = lambda rn, e=9.0, s="a": at(rn, rn=rn, error=e, sensor=s)
    batches = [
        [hot(0), hot(1), hot(0, 9.0, "b")],
        [hot(2), hot(3), hot(4, 0.0), hot(1, 0.0, "b"), hot(2, 9.0, "b")],
        [hot(5), hot(6), hot(3, 9.0, "b")],
        [hot(7), hot(8), hot(4, 9.0, "b"), hot(5, 9.0, "b")],
    ]
    out = live.run_available(live.stream_anomaly_runs(feed(spark, tmp_path, batches), 5.0, 3), str(tmp_path / "out"))
    got = sorted((r["sensor"], r["start_rn"], r["alert_rn"]) for r in out.collect())
    assert got == [("a", 0, 2), ("a", 5, 7), ("b", 2, 4)]


def plain_runs(rows, min_run):
    """(sensor, start, alert) by a plain walk over all rows of each sensor."""
    found = []
    for sensor in {r[0] for r in rows}:
        hot = {r[1] for r in rows if r[0] == sensor and r[4] > 5}
        for start in hot:
            if start - 1 not in hot and all(start + i in hot for i in range(min_run)):
                found.append((sensor, start, start + min_run - 1))
    return sorted(found)


@pytest.mark.parametrize("size", [8, 4096])
def test_runs_of_a_shuffled_replay(spark, tmp_path, size):
    """Rows late across batches, missing rows and runs over many chunks give what the whole table gives."""
    rng = random.Random(size)
    rows = []
    for sensor, n in (("a", 90), ("b", 40), ("c", 3)):
        flag = False
        for rn in range(n):
            flag = flag if rng.random() < 0.7 else not flag
            if rn not in (17, 33):  # rows that never come
                rows.append(at(rn / 60, rn=rn, error=9.0 if flag or 50 < rn < 75 else 0.0, sensor=sensor))
    mixed = rng.sample(rows, len(rows))
    batches = [mixed[i::5] for i in range(5)] + [[at(1000, rn=0, sensor="end")]]
    out = live.run_available(
        live.stream_anomaly_runs(feed(spark, tmp_path, batches), 5.0, 3, size=size), str(tmp_path / "out")
    )
    got = sorted((r["sensor"], r["start_rn"], r["alert_rn"]) for r in out.collect())
    assert got == plain_runs(rows, 3)
    assert all(r["start_time"] == DAY + dt.timedelta(minutes=r["start_rn"]) for r in out.collect())


def test_rows_behind_the_watermark_change_no_run(spark, tmp_path):
    hot = lambda rn, hours: at(hours, rn=rn, error=9.0)
    batches = [
        [hot(2, 2), hot(3, 3), hot(4, 4)],  # row 1 is open, so no alert yet
        [at(100, rn=60)],
        [at(101, rn=61)],
        [hot(1, 1), hot(0, 0)],  # too late: the run began at row 2
        [at(102, rn=62)],
    ]
    out = live.run_available(live.stream_anomaly_runs(feed(spark, tmp_path, batches), 5.0, 3), str(tmp_path / "out"))
    assert [(r["start_rn"], r["alert_rn"]) for r in out.collect()] == [(2, 4)]


def test_sessions_merge_before_the_shuffle(spark, tmp_path):
    stream = live.stream_activity_sessions(feed(spark, tmp_path, [[at(0), at(1)]]))
    query = stream.writeStream.format("memory").queryName("sessions").outputMode("append")
    query = query.option("checkpointLocation", str(tmp_path / "progress")).trigger(availableNow=True).start()
    query.awaitTermination()
    plan = query._jsq.explainInternal(False)
    exchange = plan.index("Exchange")
    assert "MergingSessions" in plan[exchange:]  # below the exchange, that is before it


def test_snapshots_and_labels(spark, tmp_path):
    for i in range(3):
        folder = tmp_path / "in" / f"2020010{i + 1}000000"
        folder.mkdir(parents=True)
        (folder / "N-B.txt").write_text(f"I, B, {i}\t{i}\t0\t0\t1\t2\n")
    rows = live.run_available(live.stream_readings(spark, str(tmp_path / "in"), files_per_trigger=1), str(tmp_path / "out"))
    assert sorted((r["ts"].day, r["strain"]) for r in rows.collect()) == [(1, 0.0), (2, 1.0), (3, 2.0)]

    vectors = spark.createDataFrame(
        [(i, [float(10 * (i % 2) + 0.1 * (i % 7)), 0.05 * (i % 5)]) for i in range(40)], "id long, scores array<double>"
    )
    model = mixture.dpgmm_fit(vectors, max_components=2, max_iter=20)
    vectors.write.parquet(str(tmp_path / "vectors"))
    arriving = spark.readStream.schema(vectors.schema).parquet(str(tmp_path / "vectors"))
    labelled = live.run_available(live.stream_label(arriving, model), str(tmp_path / "labelled"))
    assert labelled.groupBy((F.col("id") % 2).alias("p"), "cluster").count().count() == 2
