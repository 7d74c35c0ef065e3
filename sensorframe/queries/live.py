"""Queries that replay the given tables as streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from sensorframe.functions.columns import r6
from sensorframe.operators import distribution, mixture
from sensorframe.plans.sizing import store
from sensorframe.queries import views
from sensorframe.queries.registry import query
from sensorframe.queries.views import ERRORS, sql_runs
from sensorframe.streaming import live


def _events(spark, sf):
    """The events table as a file stream of readings."""
    layout = views.table(spark, sf, "events").schema
    files = spark.readStream.schema(layout).option("pathGlobFilter", "events.parquet").parquet(sf)
    return files.select(
        F.col("event_type").alias("sensor"), F.col("ts").cast("timestamp").alias("time"), F.col("value").alias("strain")
    )


def _naive(df):
    return df.withColumn("start", F.col("start").cast("timestamp_ntz")).withColumn(
        "end", F.col("end").cast("timestamp_ntz")
    )


_MEANS = """SELECT event_type AS sensor, w AS start, w + INTERVAL '{width} hours' AS "end",
    round(avg(value) + 1e-8, 6) + 0.0 AS strain, count(*) AS n
    FROM (SELECT *, unnest(generate_series(time_bucket(INTERVAL '4 hours', ts) - INTERVAL '{back} hours',
      time_bucket(INTERVAL '4 hours', ts), INTERVAL '4 hours')) AS w FROM events)
    GROUP BY event_type, w"""


@query("stream_grid_means", _MEANS.format(width=4, back=0))
def _(spark, sf):
    out = live.run_available(live.stream_grid_means(live.closing(_events(spark, sf))))
    return _naive(out).withColumn("strain", r6(F.col("strain") + 1e-8))


@query("stream_grid_means_sliding", _MEANS.format(width=24, back=20))
def _(spark, sf):
    out = live.run_available(live.stream_grid_means(live.closing(_events(spark, sf)), "24 hours", "4 hours"))
    return _naive(out).withColumn("strain", r6(F.col("strain") + 1e-8))


@query(
    "stream_activity_sessions",
    """WITH marked AS (SELECT event_type AS sensor, ts, coalesce(ts - lag(ts) OVER w >= INTERVAL '1 hour', true) AS fresh
      FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts)),
    numbered AS (SELECT *, sum(fresh::INT) OVER (PARTITION BY sensor ORDER BY ts) AS s FROM marked)
    SELECT sensor, min(ts) AS start, max(ts) + INTERVAL '1 hour' AS "end", count(*) AS n FROM numbered GROUP BY sensor, s""",
)
def _(spark, sf):
    return _naive(live.run_available(live.stream_activity_sessions(live.closing(_events(spark, sf)), "1 hour")))


@query(
    "stream_anomaly_runs",
    f"""WITH {ERRORS}, {sql_runs('errors', 'hot', 'error > 300')}
    SELECT sensor, start_rn, start_time, start_rn + 2 AS alert_rn FROM hot WHERE length >= 3""",
)
def _(spark, sf):
    errors = store(views.errors(spark, sf).select("sensor", "rn", "time", "error"))
    path = errors.inputFiles()[0].rsplit("/", 1)[0]
    arriving = spark.readStream.schema(errors.schema).parquet(path)
    out = live.run_available(live.stream_anomaly_runs(live.closing(arriving), 300.0, 3))
    return out.withColumn("start_time", F.col("start_time").cast("timestamp_ntz"))


@query("stream_label")
def _(spark, sf):
    scores = store(distribution.pca_scores(views.distributions(spark, sf), 3).select("vec_id", "scores"))
    model = mixture.dpgmm_fit(scores, max_components=5, max_iter=8)
    path = scores.inputFiles()[0].rsplit("/", 1)[0]
    arriving = spark.readStream.schema(scores.schema).parquet(path)
    out = live.run_available(live.stream_label(arriving, model))
    return out.select("vec_id", "cluster", r6("probability").alias("probability"))
