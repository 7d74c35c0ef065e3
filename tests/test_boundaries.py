"""Hand-computed edge cases."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sensorframe.operators import anomaly, cleaning, explore, filters, joins, regions, rolling, sankey

LAYOUT = "sensor string, rn bigint, time timestamp, strain double, temperature double"


def series(spark, strain, temperature=None, sensor="a"):
    temperature = temperature or [1.0] * len(strain)
    begin = dt.datetime(2020, 1, 1)
    rows = [(sensor, i, begin + dt.timedelta(hours=4 * i), s, t) for i, (s, t) in enumerate(zip(strain, temperature))]
    return spark.createDataFrame(rows, LAYOUT)


def column(df, name="strain"):
    return [r[name] for r in df.orderBy("sensor", "rn").collect()]


N = None


@pytest.mark.parametrize(
    "given,limit,want",
    [
        ([N, N, 3.0, 4.0], 2, [3.0, 3.0, 3.0, 4.0]),
        ([1.0, N, N], 2, [1.0, 1.0, 1.0]),
        ([N, N, N], 5, [N, N, N]),
        ([1.0, N, N, 4.0], 2, [1.0, 2.0, 3.0, 4.0]),
        ([1.0, N, N, 4.0], 1, [1.0, N, N, 4.0]),
        ([N, N, N, 5.0], 2, [N, N, N, 5.0]),
        ([5.0, N, N, N], 2, [5.0, N, N, N]),
    ],
)
def test_gap_limits(spark, given, limit, want):
    assert column(cleaning.interpolate_gaps(series(spark, given), limit)) == want


def test_temperature_follows_strain_gaps(spark):
    df = series(spark, [1.0, N, 3.0, N, 5.0, 6.0], [10.0, 99.0, 20.0, 7.0, N, N])
    filled = cleaning.interpolate_gaps(df, 3)
    assert column(filled, "temperature") == [10.0, 15.0, 20.0, N, N, N]
    assert column(filled) == [1.0, 2.0, 3.0, 4.0, 5.0, 6.0]


def test_outliers_need_a_full_window(spark):
    values = [1.0, 2.0, 3.0, 2.0, 1.0, 2.0, 500.0]
    assert column(cleaning.clean_zeros_outliers(series(spark, values), 3, 8, 4)) == values
    out = cleaning.clean_zeros_outliers(series(spark, values + [3.0]), 3, 8, 4)
    assert column(out)[6] is None
    tail = values[:4] * 2 + [700.0]
    assert column(cleaning.clean_zeros_outliers(series(spark, tail), 3, 8, 4))[8] == 700.0
    assert column(cleaning.clean_zeros_outliers(series(spark, tail), 3, 8, 4, tail=True))[8] is None


def test_all_missing_window_and_value_on_the_bound(spark):
    assert column(cleaning.clean_zeros_outliers(series(spark, [0.0] * 8), 3, 4, 2)) == [N] * 8
    # quartiles 1 and 3, so the bounds with k = 1 are -1 and 5
    on_bound = [0.5, 1.0, 2.0, 3.0, 5.0]
    assert column(cleaning.clean_zeros_outliers(series(spark, on_bound), 1, 5, 5)) == on_bound
    beyond = cleaning.clean_zeros_outliers(series(spark, [0.5, 1.0, 2.0, 3.0, 5.01]), 1, 5, 5)
    assert column(beyond)[4] is None


def test_rebaseline_cases(spark):
    one_point = [1.0, N, 900.0, 900.5]
    assert column(regions.rebaseline_regions(series(spark, one_point), 1.0)) == one_point
    # tail mean 2 and deviation 1, so k = 3 puts the limit at exactly 5
    at_limit = [1.0, 2.0, 3.0, N, 5.0, 5.0]
    assert column(regions.rebaseline_regions(series(spark, at_limit), 3.0)) == at_limit
    jumps = [1.0, 2.0, 3.0, N, 101.0, 102.0, 103.0, N, 501.0, 502.0, 503.0]
    want = [1.0, 2.0, 3.0, N, 1.0, 2.0, 3.0, N, 1.0, 2.0, 3.0]
    assert column(regions.rebaseline_regions(series(spark, jumps), 3.0, min_region=1)) == want
    short = [1.0, 2.0, 3.0, N, 2.0, N, 90.0, 91.0]
    assert column(regions.rebaseline_regions(series(spark, short), 3.0, min_region=2)) == [
        1.0, 2.0, 3.0, N, 2.0, N, 1.5, 2.5,
    ]


@pytest.mark.parametrize("run,kept", [(2, 0), (3, 3), (4, 4)])
def test_run_length_limit(spark, run, kept):
    df = series(spark, [0.0] * 3 + [9.0] * run + [0.0] * 3).withColumn("error", F.col("strain"))
    assert anomaly.anomaly_points(df, 5.0, 2, min_run=3).count() == kept


def test_short_series_and_no_anomaly(spark):
    df = series(spark, [9.0, 9.0]).withColumn("error", F.col("strain"))
    assert anomaly.anomaly_points(df, 5.0, 3, n=18).count() == 0
    assert anomaly.anomaly_table(anomaly.anomaly_points(df, 50.0, 2)).count() == 0
    with pytest.raises(ValueError):
        anomaly.anomaly_points(df, 5.0, 4)
    table = anomaly.anomaly_table(series(spark, [1.0] * 8)).first()
    assert table["length"] == "1 days, 4 hours"


def test_scaling(spark):
    train = series(spark, [5.0, 5.0], [0.0, 10.0])
    test = series(spark, [7.0, 5.0], [20.0, -5.0])
    _, scaled = anomaly.minmax_scale(train, test, ["strain", "temperature"])
    assert column(scaled) == [2.0, 0.0]
    assert column(scaled, "temperature") == [2.0, -0.5]


def test_trim_and_split(spark):
    trimmed = filters.trim_rows(series(spark, [1.0, 2.0, 3.0, 4.0, 5.0]), 1)
    assert column(trimmed) == [2.0, 3.0, 4.0] and column(trimmed, "rn") == [0, 1, 2]
    train, test = anomaly.chrono_split(series(spark, [float(i) for i in range(5)]), 0.5)
    assert column(train) == [0.0, 1.0] and column(test, "rn") == [0, 1, 2]


def test_grid_slice_bounds(spark):
    grid = joins.time_grid(spark, "2020-01-01 00:00:00", "2020-01-02 00:00:00")
    assert grid.count() == 7
    assert filters.grid_slice(grid, "20200101040000", "nonsense").count() == 6
    with pytest.raises(ValueError):
        filters.grid_slice(grid, "20200101040000", "nonsense", on_missing="error")


def test_spans_without_numbers_come_last(spark):
    rows = [("t", "l", "N10", 5.0), ("t", "l", "N10", 8.0), ("t", "l", "End", 1.0), ("t", "l", "N9", -2.0), ("t", "l", "N9", 2.0)]
    raw = spark.createDataFrame(rows, "ts string, loop string, span string, coord double")
    got = {(r["span"], r["coord"]): r["beam_coord"] for r in joins.beam_coordinates(raw).collect()}
    assert got == {("N9", -2.0): 0.0, ("N9", 2.0): 4.0, ("N10", 5.0): 4.0, ("N10", 8.0): 7.0, ("End", 1.0): 7.0}


def test_headers(spark):
    heads = ["Timestamp", "-1.5", "0.0", "2.5", "2.5.1", "note"]
    coords = spark.createDataFrame(list(enumerate(heads)), "pos long, header string")
    kept = [r["header"] for r in filters.filter_coords(coords, 0).orderBy("pos").collect()]
    assert kept == ["Timestamp", "0.0", "2.5", "note"]


def test_incomplete_profiles(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, N]), (3, N)], "vec_id long, profile array<double>")
    assert [r["vec_id"] for r in filters.drop_incomplete(df).collect()] == [1]


def test_constant_histogram(spark):
    got = explore.histogram(series(spark, [4.0, 4.0, N]), bins=2).orderBy("bin").collect()
    assert [(r["lo"], r["hi"], r["n"]) for r in got] == [(3.5, 4.0, 0), (4.0, 4.5, 2)]


def test_sampling_gaps(spark):
    df = series(spark, [1.0, 2.0, 3.0]).withColumn(
        "time", F.when(F.col("rn") == 2, F.lit("2020-01-01 09:30:00").cast("timestamp")).otherwise(F.col("time"))
    )
    assert [(r["rn"], r["gap_hours"]) for r in rolling.sampling_gaps(df, 4).collect()] == [(1, 5)]
    assert rolling.sampling_gaps(df, 5).count() == 0


def test_transitions(spark):
    day = dt.date
    rows = [(day(2020, 1, 1), i, i % 2) for i in range(4)] + [(day(2020, 1, 5), i, 0) for i in range(3)]
    snaps = spark.createDataFrame(rows, "snapshot_date date, pos long, cluster int")
    links = {(r[0], r[1]): r[2] for r in sankey.cluster_transitions(snaps).collect()}
    assert links == {
        ("2020-01-01_Cluster: 0", "2020-01-05_Cluster: 0"): 2,
        ("2020-01-01_Cluster: 1", "2020-01-05_Cluster: 0"): 1,
    }
    single = snaps.filter(F.col("pos") < 9).filter(F.col("snapshot_date") == "2020-01-01")
    assert sankey.cluster_transitions(single).count() == 0
    nodes = spark.createDataFrame([("2020-01-01_Cluster: 0", 0), ("2020-01-01_Cluster: 1", 1)], "name string, id int")
    assert {(r["x"], r["y"]) for r in sankey.sankey_positions(nodes).collect()} == {(0.0, 0.0), (0.0, 0.5)}


def test_supports_take_the_nearest_coordinate(spark):
    points = spark.createDataFrame([("B", 0.0), ("B", 38.0), ("B", 40.0)], "beam string, coord double")
    supports = spark.createDataFrame([("B", "I", 0.4), ("B", "II", 39.0)], "beam string, support string, coord double")
    got = {r["coord"]: r["support"] for r in joins.with_supports(points, supports).collect()}
    assert got == {0.0: "I", 38.0: "II", 40.0: None}


def test_null_keys_and_empty_groups_do_not_depend_on_size(spark):
    """Both arms of numbering and of quantiles keep NULL keys and groups without values."""
    from sensorframe.functions.quantiles import exact_quantiles
    from sensorframe.plans.scan import number_by_time

    rows = [(name, k, float(k * 7 % 11) if name != "empty" else None) for name in ("a", None, "empty") for k in range(40)]
    df = spark.createDataFrame(rows, "sensor string, n int, x double").withColumn("time", F.timestamp_seconds("n"))
    few = number_by_time(df).select("sensor", "n", "rn").collect()
    many = number_by_time(df, rows_per_bucket=2).select("sensor", "n", "rn").collect()
    assert len(few) == 120 and sorted(map(str, few)) == sorted(map(str, many))
    for keys in (["sensor"], []):
        exact = exact_quantiles(df, keys, "x", [0.25, 0.5, 0.9]).collect()
        bracketed = exact_quantiles(df, keys, "x", [0.25, 0.5, 0.9], buffer_rows=5, accuracy=10).collect()
        assert len(exact) == (3 if keys else 1)

        def plain(found):
            return {r["sensor"] if keys else None: r["q"] and [round(q, 9) for q in r["q"]] for r in found}

        assert plain(exact) == plain(bracketed)
    nothing = exact_quantiles(df.filter("sensor = 'empty'"), [], "x", [0.5], buffer_rows=-1).collect()
    assert len(nothing) == 1 and nothing[0]["q"] is None


def test_correlation_of_very_many_sensors(spark):
    rng = np.random.default_rng(8)
    sensors, moments = 5_000, 6
    x = rng.normal(size=(moments, sensors))
    x[rng.random(x.shape) < 0.2] = np.nan
    at = np.argwhere(~np.isnan(x))
    frame = pd.DataFrame({"time": at[:, 0], "sensor": [f"s{j:04d}" for j in at[:, 1]], "strain": x[at[:, 0], at[:, 1]]})
    found = explore.pairwise_correlation(spark.createDataFrame(frame).repartition(8)).cache()
    present = (~np.isnan(x)).astype(float)
    shared = present.T @ present
    assert found.count() == (np.count_nonzero(shared) + np.count_nonzero(np.diag(shared))) // 2
    for r in found.filter("hash(sensor_a, sensor_b) % 50000 = 0").collect():
        i, j = int(r["sensor_a"][1:]), int(r["sensor_b"][1:])
        both = ~np.isnan(x[:, i]) & ~np.isnan(x[:, j])
        assert r["n"] == both.sum() and i <= j
        if both.sum() > 2 and i != j:
            assert abs(r["corr"] - np.corrcoef(x[both, i], x[both, j])[0, 1]) < 1e-9
    found.unpersist()
