"""Readers and writers on small files."""

import datetime as dt

import pytest

from sensorframe.operators import filters, joins
from sensorframe.sources import readers, writers

LINES = "II, B, 0.06\t-12.5\t0\t0\t7.25\t38.82\nII, B, 0.06\t-99\t0\t0\t1\t38.82\n\nII, B, x\tnan\t0\t0\tbad\n"


@pytest.fixture()
def snapshots(tmp_path):
    for stamp, text in (("20200101000000", LINES), ("20200101040000", "head\nIII, B, 1.5\t3\t0\t0\t4\t5\n")):
        (tmp_path / stamp).mkdir()
        (tmp_path / stamp / "N-B.txt").write_text(text)
        (tmp_path / stamp / "other.txt").write_text("I, C, 1\t1\t0\t0\t2\t3\n")
    return str(tmp_path)


def test_raw_readings(spark, snapshots):
    rows = readers.read_raw_readings(spark, snapshots, ["N-B.txt"]).orderBy("ts", "line").collect()
    first = rows[0]
    assert first["ts"] == dt.datetime(2020, 1, 1) and first["loop"] == "N-B.txt" and first["line"] == 0
    assert (first["span"], first["beam"], first["coord"]) == ("II", "B", 0.06)
    assert (first["strain"], first["temp"], first["distance"]) == (-12.5, 7.25, 38.82)
    assert first["position"] == "II,B,0.06"
    bad = rows[2]
    assert bad["coord"] is None and bad["strain"] is None and bad["temp"] is None and bad["distance"] is None
    assert readers.read_raw_readings(spark, snapshots).count() == 7


def test_extraction(spark, snapshots, tmp_path):
    path = tmp_path / "requests.cfg"
    path.write_text("20200101000000 20200101080000 N-B.txt II, B, 0.06 4\n20200101040000 no N-B.txt V, B, 9 4\n")
    requests = readers.read_requests(spark, str(path))
    assert [r["position"] for r in requests.orderBy("position").collect()] == ["II,B,0.06", "V,B,9"]
    raw = readers.read_raw_readings(spark, snapshots)
    got = joins.extract_series(raw, requests, "2020-01-01 00:00:00", "2020-01-01 08:00:00")
    rows = {(r["position"], r["time_index"]): (r["strain"], r["temperature"]) for r in got.collect()}
    assert rows == {
        ("II,B,0.06", "20200101000000"): (-12.5, 7.25),
        ("II,B,0.06", "20200101040000"): (None, None),
        ("II,B,0.06", "20200101080000"): (None, None),
        ("V,B,9", "20200101040000"): (None, None),
        ("V,B,9", "20200101080000"): (None, None),
    }


def test_distribution_values(spark, snapshots):
    got = readers.read_distribution_values(spark, snapshots, "N-B.txt").orderBy("ts", "line").collect()
    assert [(r["line"], r["value"]) for r in got] == [(1, None), (3, None), (1, None)]


def test_series_csv(spark, tmp_path):
    (tmp_path / "beam one.csv").write_text(
        "Time_index,Time,Strain,Temperature\n20200101040000,2020-01-01 04:00:00,2.5,nan\n"
        "x,never,1,1\n20200101000000,2020-01-01 00:00:00,,4\n"
    )
    rows = readers.read_series_csv(spark, str(tmp_path)).orderBy("rn").collect()
    assert [(r["sensor"], r["rn"], r["strain"], r["temperature"]) for r in rows] == [
        ("beam one", 0, 2.5, None), ("beam one", 1, 1.0, 1.0), ("beam one", 2, None, 4.0),
    ]
    assert [r["time"] is None for r in rows] == [False, True, False]


def test_alarm_texts(spark, tmp_path):
    (tmp_path / "20200101000000").mkdir()
    (tmp_path / "20200101000000" / "mail.txt").write_bytes("Brücke;N-B".encode("latin-1"))
    row = readers.read_alarm_texts(spark, str(tmp_path), "mail.txt").first()
    assert (row["ts"], row["text"]) == (dt.datetime(2020, 1, 1), "Brücke;N-B")


def test_wide_matrix(spark, tmp_path):
    path = str(tmp_path / "matrix.csv")
    (tmp_path / "matrix.csv").write_text("Timestamp,-1.0,2.5,2.5,5.0\n2020-01-01 040000,1,2,3,nan\n")
    matrix, coords = readers.read_distribution_csv(spark, path)
    assert [r["header"] for r in coords.orderBy("pos").collect()] == ["Timestamp", "-1.0", "2.5", "2.5.1", "5.0"]
    kept = readers.select_coords(matrix, filters.filter_coords(coords, 0))
    assert matrix.first()["profile"] == [1.0, 2.0, 3.0, None]
    assert kept.first()["profile"] == [2.0, None]


def test_name_list(spark, tmp_path):
    (tmp_path / "names.lst").write_text(" 2020 \nabc\n\n12\n")
    path = str(tmp_path / "names.lst")
    assert readers.read_name_list(spark, path).count() == 3
    assert sorted(r[0] for r in readers.read_name_list(spark, path, digits_only=True).collect()) == ["12", "2020"]


def test_series_are_written_in_chunks(spark, tmp_path):
    rows = spark.range(100).selectExpr("'a' sensor", "id rn", "double(id) strain")
    writers.write_series(rows, str(tmp_path / "out"), size=30)
    files = list((tmp_path / "out" / "sensor=a").glob("*.parquet"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 100 and len(files) >= 1
    writers.write_series(rows, str(tmp_path / "text"), fmt="csv")
    assert spark.read.csv(str(tmp_path / "text"), header=True).count() == 100
