"""Queries over the sensor series: cleaning, regions, frames, anomalies."""

from __future__ import annotations

from pyspark.sql import functions as F

from sensorframe.functions.columns import r6
from sensorframe.operators import anomaly, cleaning, filters, regions, rolling
from sensorframe.queries import views
from sensorframe.queries.registry import query
from sensorframe.queries.views import ERRORS, READINGS, SHIFTS, readings, sql_clean, sql_fill, sql_runs

SERIES = "sensor, rn, time, round(strain + 1e-9, 6) + 0.0 AS strain, round(temperature + 1e-9, 6) + 0.0 AS temperature"


def _series(df):
    return df.select("sensor", "rn", "time", r6("strain").alias("strain"), r6("temperature").alias("temperature"))


@query("readings", f"WITH {READINGS} SELECT {SERIES} FROM readings")
def _(spark, sf):
    return _series(readings(spark, sf))


@query("zero_to_null", f"WITH {READINGS} SELECT {SERIES} FROM nonzero")
def _(spark, sf):
    return _series(filters.zero_to_null(readings(spark, sf)))


@query("drop_zero_rows", f"WITH {READINGS} SELECT {SERIES} FROM readings WHERE strain IS NULL OR strain <> 0")
def _(spark, sf):
    return _series(filters.drop_zero_rows(readings(spark, sf)))


@query(
    "renumber",
    f"""WITH {READINGS} SELECT sensor, row_number() OVER (PARTITION BY sensor ORDER BY rn) - 1 AS rn, time,
    round(strain + 1e-9, 6) + 0.0 AS strain, round(temperature + 1e-9, 6) + 0.0 AS temperature
    FROM readings WHERE strain IS NULL OR strain <> 0""",
)
def _(spark, sf):
    return _series(filters.renumber(filters.drop_zero_rows(readings(spark, sf))))


@query(
    "time_range",
    f"WITH {READINGS} SELECT {SERIES} FROM readings "
    "WHERE time BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-12 12:00:00'",
)
def _(spark, sf):
    return _series(filters.time_range(readings(spark, sf), "2024-01-05", "2024-01-12 12:00:00"))


@query(
    "trim_rows",
    f"""WITH {READINGS} SELECT sensor, rn - 30 AS rn, time, round(strain + 1e-9, 6) + 0.0 AS strain,
    round(temperature + 1e-9, 6) + 0.0 AS temperature
    FROM readings JOIN lens USING (sensor) WHERE rn >= 30 AND rn < n - 1""",
)
def _(spark, sf):
    return _series(filters.trim_rows(readings(spark, sf), 30))


@query("head_rows", f"WITH {READINGS} SELECT {SERIES} FROM readings ORDER BY sensor, rn LIMIT 50")
def _(spark, sf):
    return _series(filters.head_rows(readings(spark, sf), 50))


@query(
    "drop_incomplete",
    f"WITH {READINGS} SELECT {SERIES} FROM readings WHERE strain IS NOT NULL AND temperature IS NOT NULL",
)
def _(spark, sf):
    return _series(filters.drop_incomplete(readings(spark, sf)))


@query(
    "fill_missing",
    f"""WITH {READINGS} SELECT sensor, rn, time, round(coalesce(strain, 0) + 1e-9, 6) + 0.0 AS strain,
    round(coalesce(temperature, 0) + 1e-9, 6) + 0.0 AS temperature FROM readings""",
)
def _(spark, sf):
    return _series(filters.fill_missing(readings(spark, sf), 0, ["strain", "temperature"]))


@query(
    "window_membership",
    f"""WITH {READINGS}, {sql_clean('nonzero', 'clean')} SELECT sensor, rn, w FROM clean_m""",
)
def _(spark, sf):
    return cleaning.window_membership(readings(spark, sf), 100, 20).select("sensor", "rn", "w")


@query("clean_zeros_outliers", f"WITH {READINGS}, {sql_clean('nonzero', 'clean')} SELECT {SERIES} FROM clean")
def _(spark, sf):
    return _series(cleaning.clean_zeros_outliers(readings(spark, sf), 3, 100, 20))


@query(
    "clean_zeros_outliers_training",
    f"WITH {READINGS}, {sql_clean('nonzero', 'clean', 1.5, 70, 30)} SELECT {SERIES} FROM clean",
)
def _(spark, sf):
    return _series(cleaning.clean_zeros_outliers(readings(spark, sf), 1.5, 70, 30))


@query("interpolate_gaps", f"WITH {READINGS}, {sql_fill('nonzero', 'filled', 20)} SELECT {SERIES} FROM filled")
def _(spark, sf):
    return _series(cleaning.interpolate_gaps(filters.zero_to_null(readings(spark, sf)), 20))


@query(
    "preprocess",
    f"WITH {READINGS}, {sql_clean('nonzero', 'clean')}, {sql_fill('clean', 'filled', 20)} SELECT {SERIES} FROM filled",
)
def _(spark, sf):
    return _series(cleaning.preprocess(readings(spark, sf), 20))


@query("gap_regions", f"WITH {READINGS}, {sql_runs('nonzero', 'gaps', 'strain IS NULL')} SELECT * FROM gaps")
def _(spark, sf):
    return regions.gap_regions(filters.zero_to_null(readings(spark, sf)))


@query(
    "valid_regions",
    f"WITH {READINGS}, {sql_runs('nonzero', 'valid', 'strain IS NOT NULL')} SELECT * FROM valid WHERE length >= 25",
)
def _(spark, sf):
    return regions.valid_regions(filters.zero_to_null(readings(spark, sf)), 25)


@query(
    "longest_regions",
    f"""WITH {READINGS}, {sql_runs('nonzero', 'gaps', 'strain IS NULL')}
    SELECT * FROM gaps ORDER BY length DESC, start_rn, sensor LIMIT 20""",
)
def _(spark, sf):
    return regions.longest_regions(regions.gap_regions(filters.zero_to_null(readings(spark, sf))), 20)


@query("order_by_time", f"WITH {READINGS} SELECT {SERIES} FROM readings ORDER BY time")
def _(spark, sf):
    return _series(regions.order_by_time(readings(spark, sf)))


_COVERED = f"""WITH {READINGS},
points AS (SELECT rn FROM nonzero WHERE strain IS NOT NULL
           GROUP BY rn HAVING count(*) = (SELECT count(DISTINCT sensor) FROM nonzero)),
isles AS (SELECT rn, rn - row_number() OVER (ORDER BY rn) AS g FROM points),
both_ AS (SELECT min(rn) AS start_rn, max(rn) AS end_rn FROM isles GROUP BY g)
SELECT start_rn, end_rn FROM both_ WHERE end_rn - start_rn >= 10"""


@query("overlapping_regions", _COVERED)
def _(spark, sf):
    valid = regions.valid_regions(filters.zero_to_null(readings(spark, sf)), 1)
    return regions.overlapping_regions(valid, 10)


@query(
    "center_regions",
    f"""WITH {READINGS}, {sql_runs('nonzero', 'valid', 'strain IS NOT NULL')},
    means AS (SELECT sensor, island, avg(strain) AS m FROM valid_i GROUP BY 1, 2),
    centred AS (SELECT v.sensor, v.rn, v.strain - m AS strain FROM valid_i v JOIN means USING (sensor, island))
    SELECT n.sensor, n.rn, n.time, round(c.strain + 1e-9, 6) + 0.0 AS strain, round(temperature + 1e-9, 6) + 0.0 AS temperature
    FROM nonzero n LEFT JOIN centred c ON n.sensor = c.sensor AND n.rn = c.rn""",
)
def _(spark, sf):
    return _series(regions.center_regions(filters.zero_to_null(readings(spark, sf))))


_REBASE = f"""WITH {READINGS}, {sql_runs('nonzero', 'valid', 'strain IS NOT NULL')},
pos AS (SELECT *, min(rn) OVER r AS s, max(rn) OVER r AS e FROM valid_i WINDOW r AS (PARTITION BY sensor, island)),
stats AS (SELECT sensor, s, e, avg(CASE WHEN rn < s + 20 THEN strain END) AS head,
   avg(CASE WHEN rn > e - 20 THEN strain END) AS tail,
   stddev_samp(CASE WHEN rn > e - 20 THEN strain END) AS noise FROM pos GROUP BY sensor, s, e),
prevs AS (SELECT *, row_number() OVER o - 1 AS i, lag(tail) OVER o AS pt, lag(noise) OVER o AS pn,
   lag(noise, 2) OVER o AS pn2, lag(e - s + 1) OVER o AS pl FROM stats WINDOW o AS (PARTITION BY sensor ORDER BY s)),
picked AS (SELECT *, CASE WHEN pl < 5 AND i > 1 THEN pn2 ELSE pn END AS sd FROM prevs),
deltas AS (SELECT sensor, s, e,
   CASE WHEN head < pt - 4.6 * sd OR head > pt + 4.6 * sd THEN pt - head ELSE 0 END AS delta FROM picked),
shifted AS (SELECT sensor, s, e, delta, sum(delta) OVER (PARTITION BY sensor ORDER BY s) AS shift FROM deltas)"""


@query(
    "rebaseline_regions",
    _REBASE
    + """ SELECT n.sensor, n.rn, n.time, round(n.strain + coalesce(shift, 0) + 1e-9, 6) + 0.0 AS strain,
    round(n.temperature + 1e-9, 6) + 0.0 AS temperature
    FROM nonzero n LEFT JOIN pos p ON n.sensor = p.sensor AND n.rn = p.rn
    LEFT JOIN shifted h ON p.sensor = h.sensor AND p.s = h.s""",
)
def _(spark, sf):
    return _series(regions.rebaseline_regions(filters.zero_to_null(readings(spark, sf))))


@query(
    "region_shifts",
    _REBASE
    + """ SELECT sensor, s AS run_start, e AS run_end, round(delta + 1e-9, 6) + 0.0 AS delta,
    round(shift + 1e-9, 6) + 0.0 AS shift FROM shifted""",
)
def _(spark, sf):
    found = regions.region_shifts(filters.zero_to_null(readings(spark, sf)))
    return found.select("sensor", "run_start", "run_end", r6("delta").alias("delta"), r6("shift").alias("shift"))


_SHIFTED = f"""WITH {READINGS}, {SHIFTS},
amounts AS (SELECT s.*, a.strain - b.strain AS amount FROM shifts s
  JOIN nonzero a ON a.sensor = s.sensor AND a.rn = s.ref_rn
  JOIN nonzero b ON b.sensor = s.sensor AND b.rn = s.start_rn),
moved AS (SELECT n.sensor, n.rn, n.time, n.strain + coalesce(amount, 0) AS strain, n.temperature
  FROM nonzero n LEFT JOIN amounts a ON a.sensor = n.sensor AND n.rn BETWEEN a.start_rn AND a.end_rn)"""


@query("apply_shifts", f"{_SHIFTED} SELECT {SERIES} FROM moved")
def _(spark, sf):
    rows = filters.zero_to_null(readings(spark, sf))
    return _series(regions.apply_shifts(rows, views.shifts(spark, sf)))


@query(
    "merge_segment",
    f"""{_SHIFTED} SELECT r.sensor, r.rn, r.time,
    round(CASE WHEN r.rn BETWEEN 86 AND 140 THEN m.strain ELSE r.strain END + 1e-9, 6) + 0.0 AS strain,
    round(r.temperature + 1e-9, 6) + 0.0 AS temperature
    FROM readings r JOIN moved m ON r.sensor = m.sensor AND r.rn = m.rn""",
)
def _(spark, sf):
    original, spans = readings(spark, sf), views.shifts(spark, sf)
    moved = regions.apply_shifts(filters.zero_to_null(original), spans)
    return _series(regions.merge_segment(original, moved, spans))


@query(
    "rolling_features",
    f"""WITH {READINGS} SELECT sensor, rn,
    CASE WHEN count(strain) OVER w = 6 THEN round(avg(strain) OVER w + 1e-8, 5) + 0.0 END AS rolling_mean,
    CASE WHEN count(strain) OVER w = 6 THEN round(var_samp(strain) OVER w + 1e-6, 4) + 0.0 END AS rolling_var,
    CASE WHEN count(strain) OVER w = 6 THEN round(stddev_samp(strain) OVER w + 1e-8, 5) + 0.0 END AS rolling_std
    FROM nonzero WINDOW w AS (PARTITION BY sensor ORDER BY rn ROWS BETWEEN 5 PRECEDING AND CURRENT ROW)""",
)
def _(spark, sf):
    out = rolling.rolling_features(filters.zero_to_null(readings(spark, sf)))
    return out.select(
        "sensor",
        "rn",
        (F.round(F.col("rolling_mean") + 1e-8, 5) + 0.0).alias("rolling_mean"),
        (F.round(F.col("rolling_var") + 1e-6, 4) + 0.0).alias("rolling_var"),
        (F.round(F.col("rolling_std") + 1e-8, 5) + 0.0).alias("rolling_std"),
    )


@query(
    "rolling_mean",
    f"""WITH {READINGS} SELECT sensor, rn, round(avg(strain) OVER (PARTITION BY sensor ORDER BY rn
    ROWS BETWEEN 41 PRECEDING AND CURRENT ROW) + 1e-8, 5) + 0.0 AS weekly FROM nonzero""",
)
def _(spark, sf):
    out = rolling.rolling_mean(filters.zero_to_null(readings(spark, sf)), window=42, out="weekly")
    return out.select("sensor", "rn", (F.round(F.col("weekly") + 1e-8, 5) + 0.0).alias("weekly"))


@query(
    "sampling_gaps",
    f"""WITH {READINGS}, nexts AS (SELECT sensor, rn, time, lead(time) OVER (PARTITION BY sensor ORDER BY rn) AS next_time
    FROM readings) SELECT *, CAST(floor(date_diff('second', time, next_time) / 3600.0) AS BIGINT) AS gap_hours FROM nexts
    WHERE epoch_us(next_time) - epoch_us(time) >= 3600000000 * 2""",
)
def _(spark, sf):
    gaps = rolling.sampling_gaps(readings(spark, sf), hours=1)
    return gaps.select("sensor", "rn", "time", "next_time", "gap_hours")


@query(
    "kalman_filter",
    f"""WITH RECURSIVE {READINGS},
    seen AS (SELECT sensor, time, strain, row_number() OVER (PARTITION BY sensor ORDER BY rn) - 1 AS rn
      FROM nonzero WHERE strain IS NOT NULL),
    gains AS (
      SELECT 0 AS t, (1.0 + 0.01)::DOUBLE / (1.0 + 0.01 + 10.0) AS g,
             (1 - (1.0 + 0.01)::DOUBLE / (1.0 + 0.01 + 10.0)) * (1.0 + 0.01) AS p
      UNION ALL
      SELECT t + 1, (p + 0.01) / (p + 0.01 + 10.0), (1 - (p + 0.01) / (p + 0.01 + 10.0)) * (p + 0.01)
      FROM gains WHERE t < (SELECT max(rn) FROM seen)),
    walk AS (
      SELECT sensor, rn, time, g * strain AS x FROM seen JOIN gains ON t = 0 WHERE rn = 0
      UNION ALL
      SELECT s.sensor, s.rn, s.time, w.x + g * (s.strain - w.x)
      FROM walk w JOIN seen s ON s.sensor = w.sensor AND s.rn = w.rn + 1 JOIN gains ON t = s.rn)
    SELECT sensor, rn, time, round(x + 1e-8, 5) AS state FROM walk""",
)
def _(spark, sf):
    out = rolling.kalman_filter(filters.zero_to_null(readings(spark, sf)), 1.0, 1.0, 1e-2, 10.0, 0.0, 1.0)
    return out.select("sensor", "rn", "time", F.round(F.col("state")[0] + 1e-8, 5).alias("state"))


@query(
    "chrono_split",
    f"""WITH {READINGS} SELECT sensor, CASE WHEN rn < floor(n * 0.7) THEN rn ELSE rn - floor(n * 0.7)::BIGINT END AS rn,
    time, rn < floor(n * 0.7) AS train FROM readings JOIN lens USING (sensor)""",
)
def _(spark, sf):
    train, test = anomaly.chrono_split(readings(spark, sf), 0.3)
    both = train.withColumn("train", F.lit(True)).unionByName(test.withColumn("train", F.lit(False)))
    return both.select("sensor", "rn", "time", "train")


_SEQ = f"""WITH {READINGS}, s AS (SELECT sensor, rn, first_value(time) OVER w AS time, last_value(time) OVER w AS end_time,
   count(*) OVER (PARTITION BY sensor ORDER BY rn ROWS BETWEEN CURRENT ROW AND 8 FOLLOWING) AS have,
   sum(coalesce(strain, 0)) OVER w AS total, count(strain) OVER w AS present, first_value(temperature) OVER w AS first_temp,
   last_value(temperature) OVER w AS last_temp
   FROM nonzero WINDOW w AS (PARTITION BY sensor ORDER BY rn ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING))"""


@query(
    "sequences",
    f"""{_SEQ} SELECT sensor, rn, time, CAST(8 AS INT) AS steps, round(total, 5) + 0.0 AS total, present,
    first_temp, last_temp FROM s WHERE have = 9""",
)
def _(spark, sf):
    rows = filters.zero_to_null(readings(spark, sf))
    out = anomaly.sequences(rows, 8, ["strain", "temperature"])
    strains = F.array_compact(F.transform("sequence", lambda s: s["strain"]))
    return out.select(
        "sensor",
        "rn",
        "time",
        F.size("sequence").alias("steps"),
        (F.round(F.aggregate(strains, F.lit(0.0), lambda a, x: a + x), 5) + 0.0).alias("total"),
        F.size(strains).cast("long").alias("present"),
        F.col("sequence")[0]["temperature"].alias("first_temp"),
        F.col("sequence")[7]["temperature"].alias("last_temp"),
    )


@query("sequence_timestamps", f"{_SEQ} SELECT sensor, rn, end_time AS time FROM s WHERE have = 9")
def _(spark, sf):
    return anomaly.sequence_timestamps(readings(spark, sf), 8, label="end")


@query(
    "sequence_overlap",
    f"""WITH {READINGS}, parts AS (SELECT sensor, rn < floor(n * 0.7) AS train, rn, temperature
      FROM readings JOIN lens USING (sensor)),
    seqs AS (SELECT train, CAST(temperature AS FLOAT) AS v0,
      CAST(lead(temperature) OVER w AS FLOAT) AS v1, lead(rn, 2) OVER w AS more
      FROM parts WINDOW w AS (PARTITION BY sensor, train ORDER BY rn))
    SELECT v0, v1 FROM seqs WHERE train AND more IS NOT NULL
    INTERSECT SELECT v0, v1 FROM seqs WHERE NOT train AND more IS NOT NULL""",
)
def _(spark, sf):
    train, test = anomaly.chrono_split(readings(spark, sf), 0.3)
    shared = anomaly.sequence_overlap(
        anomaly.sequences(train, 2, ["temperature"]), anomaly.sequences(test, 2, ["temperature"])
    )
    return shared.select(F.col("values")[0].alias("v0"), F.col("values")[1].alias("v1"))


@query(
    "minmax_scale",
    f"""WITH {READINGS}, parts AS (SELECT r.*, rn < floor(n * 0.7) AS train, floor(n * 0.7)::BIGINT AS cut
      FROM nonzero r JOIN lens USING (sensor)),
    ranges AS (SELECT sensor, min(strain) AS a, max(strain) AS b, min(temperature) AS c, max(temperature) AS d
      FROM parts WHERE train GROUP BY sensor)
    SELECT sensor, CASE WHEN train THEN rn ELSE rn - cut END AS rn, train,
      round((strain - a) / coalesce(nullif(b - a, 0), 1) + 1e-9, 6) + 0.0 AS strain,
      round((temperature - c) / coalesce(nullif(d - c, 0), 1) + 1e-9, 6) + 0.0 AS temperature
    FROM parts JOIN ranges USING (sensor)""",
)
def _(spark, sf):
    train, test = anomaly.chrono_split(filters.zero_to_null(readings(spark, sf)), 0.3)
    train, test = anomaly.minmax_scale(train, test, ["strain", "temperature"])
    both = train.withColumn("train", F.lit(True)).unionByName(test.withColumn("train", F.lit(False)))
    return both.select(
        "sensor", "rn", "train", r6("strain").alias("strain"), r6("temperature").alias("temperature")
    )


@query(
    "concat_features",
    f"""WITH {READINGS} SELECT rn,
    {", ".join(f'''max(CASE WHEN sensor = '{s}' THEN {f} END) AS "{s} - {f}"'''
               for s in ("click", "error", "purchase", "signup", "view") for f in ("strain", "temperature"))}
    FROM nonzero GROUP BY rn""",
)
def _(spark, sf):
    return anomaly.concat_features(filters.zero_to_null(readings(spark, sf)), ["strain", "temperature"])


_ROLLED = ERRORS + """,
rolled AS (SELECT * FROM (SELECT *, avg(error) OVER w AS rolling_error, count(*) OVER w AS have FROM errors
  WINDOW w AS (PARTITION BY sensor ORDER BY rn ROWS BETWEEN CURRENT ROW AND 17 FOLLOWING)) WHERE have = 18)"""


@query("rolling_error", f"WITH {_ROLLED} SELECT sensor, rn, time, round(rolling_error + 1e-9, 6) + 0.0 AS rolling_error FROM rolled")
def _(spark, sf):
    out = anomaly.rolling_error(views.errors(spark, sf), 18)
    return out.select("sensor", "rn", "time", r6("rolling_error").alias("rolling_error"))


@query(
    "error_threshold",
    f"""WITH {ERRORS} SELECT round(avg(error) + 1e-9, 6) AS mean_error, round(stddev_pop(error) + 1e-9, 6) AS std_error,
    round(avg(error) + 10 * stddev_pop(error) + 1e-8, 5) AS threshold FROM errors""",
)
def _(spark, sf):
    return anomaly.error_threshold(views.errors(spark, sf)).select(
        r6("mean_error").alias("mean_error"),
        r6("std_error").alias("std_error"),
        F.round(F.col("threshold") + 1e-8, 5).alias("threshold"),
    )


@query(
    "score_table",
    f"WITH {ERRORS} SELECT sensor, rn, round(error + 1e-9, 6) + 0.0 AS error FROM errors",
)
def _(spark, sf):
    both = views.errors(spark, sf)
    out = anomaly.score_table(both.select("sensor", "rn", "actual"), both.select("sensor", "rn", "reconstructed"))
    return out.select("sensor", "rn", r6("error").alias("error"))


@query("anomaly_points_single", f"WITH {ERRORS} SELECT sensor, rn, time, round(error + 1e-9, 6) AS error FROM errors WHERE error > 400")
def _(spark, sf):
    out = anomaly.anomaly_points(views.errors(spark, sf), 400.0, 1)
    return out.select("sensor", "rn", "time", r6("error").alias("error"))


_POINTS2 = f"""WITH {ERRORS}, {sql_runs('errors', 'hot', 'error > 300')},
kept AS (SELECT i.* FROM hot_i i JOIN hot h ON i.sensor = h.sensor AND i.rn BETWEEN h.start_rn AND h.end_rn
         WHERE length >= 3)"""


@query("anomaly_points_runs", f"{_POINTS2} SELECT sensor, rn, time, round(error + 1e-9, 6) AS error FROM kept")
def _(spark, sf):
    out = anomaly.anomaly_points(views.errors(spark, sf), 300.0, 2, min_run=3)
    return out.select("sensor", "rn", "time", r6("error").alias("error"))


_POINTS3 = f"""WITH {_ROLLED}, {sql_runs('rolled', 'hot', 'rolling_error > 250')},
kept AS (SELECT i.* FROM hot_i i JOIN hot h ON i.sensor = h.sensor AND i.rn BETWEEN h.start_rn AND h.end_rn
         WHERE length >= 18)"""


@query(
    "anomaly_points_rolling",
    f"{_POINTS3} SELECT sensor, rn, time, round(rolling_error + 1e-9, 6) AS rolling_error FROM kept",
)
def _(spark, sf):
    out = anomaly.anomaly_points(views.errors(spark, sf), 250.0, 3)
    return out.select("sensor", "rn", "time", r6("rolling_error").alias("rolling_error"))


@query(
    "anomaly_table",
    f"""{_POINTS3}, {sql_runs('kept', 'found', 'true').replace('SELECT *,', 'SELECT sensor, rn, time,')}
    SELECT sensor, start_time, end_time,
      CAST(floor((epoch_us(end_time) - epoch_us(start_time)) / 86400000000) AS BIGINT) || ' days, ' ||
      CAST(floor(((epoch_us(end_time) - epoch_us(start_time)) % 86400000000) / 3600000000) AS BIGINT) || ' hours' AS length
    FROM found""",
)
def _(spark, sf):
    return anomaly.anomaly_table(anomaly.anomaly_points(views.errors(spark, sf), 250.0, 3))


@query("reconstruction_error")
def _(spark, sf):
    rows = filters.trim_rows(readings(spark, sf), 10)
    train, test = anomaly.chrono_split(rows, 0.3)
    train = rolling.rolling_features(cleaning.preprocess(train))
    test = rolling.rolling_features(cleaning.preprocess(test))
    columns = ["strain", "temperature", "rolling_mean", "rolling_std"]
    train = filters.fill_missing(train, 0, columns)
    test = filters.fill_missing(test, 0, columns)
    out = anomaly.reconstruction_error(train, test, columns, 4)
    return out.select("sensor", "rn", "time", "feature", r6("error").alias("error"))
