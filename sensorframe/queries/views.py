"""Views over the given tables in the shapes the operators take, as plans and as SQL.

The events become five sensor series with planted zeros, gaps and level jumps; the
embeddings become daily strain profiles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from sensorframe.functions.columns import grid_floor
from sensorframe.operators import joins, rolling
from sensorframe.plans.scan import number_by_sort, number_by_time


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def events_numbered(spark: SparkSession, sf: str) -> DataFrame:
    events = table(spark, sf, "events").select(
        F.col("event_type").alias("sensor"), F.col("ts").alias("time"), "event_id", "user_id", "value"
    )
    return number_by_time(events, ties=["event_id"])


def planted(df: DataFrame) -> DataFrame:
    rn = F.col("rn")
    raised = F.col("value") + F.when(rn % 180 >= 85, 2000.0).otherwise(0.0)
    strain = (
        F.when((rn % 90).between(60, 84), F.lit(None).cast("double"))
        .when((rn % 37 == 0) | (rn % 53 < 3), 0.0)
        .otherwise(raised)
    )
    temperature = F.when(rn % 41 != 0, (F.col("user_id") % 40).cast("double"))
    return df.withColumn("strain", strain).withColumn("temperature", temperature)


def readings(spark: SparkSession, sf: str) -> DataFrame:
    return planted(events_numbered(spark, sf)).select("sensor", "rn", "time", "strain", "temperature")


READINGS = """
numbered AS (
  SELECT event_type AS sensor, ts AS time, value, user_id, event_id,
         row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS rn
  FROM events),
readings AS (
  SELECT sensor, rn, time,
    CASE WHEN rn % 90 BETWEEN 60 AND 84 THEN NULL
         WHEN rn % 37 = 0 OR rn % 53 < 3 THEN 0.0
         ELSE value + CASE WHEN rn % 180 >= 85 THEN 2000.0 ELSE 0.0 END END AS strain,
    CASE WHEN rn % 41 = 0 THEN NULL ELSE CAST(user_id % 40 AS DOUBLE) END AS temperature
  FROM numbered),
nonzero AS (SELECT sensor, rn, time, nullif(strain, 0.0) AS strain, temperature FROM readings),
lens AS (SELECT sensor, max(rn) + 1 AS n FROM readings GROUP BY sensor)"""


def sql_clean(src: str, dst: str, k: float = 3, window: int = 100, step: int = 20) -> str:
    """CTEs that null the windowed-IQR outliers of ``src`` (columns of readings)."""
    return f"""
{dst}_m AS (
  SELECT s.*, unnest(range(greatest(ceil((rn - {window} + 1) / {step}.0), 0)::BIGINT,
                           least(floor(rn / {step}.0), floor((n - {window}) / {step}.0))::BIGINT + 1)) AS w
  FROM {src} s JOIN (SELECT sensor, max(rn) + 1 AS n FROM {src} GROUP BY sensor) USING (sensor)
  WHERE n >= {window}),
{dst}_q AS (
  SELECT sensor, w, quantile_cont(strain, 0.25) AS s1, quantile_cont(strain, 0.75) AS s3,
         quantile_cont(temperature, 0.25) AS t1, quantile_cont(temperature, 0.75) AS t3
  FROM {dst}_m GROUP BY sensor, w),
{dst}_b AS (
  SELECT sensor, w, round(s1 - {k} * (s3 - s1), 9) AS slo, round(s3 + {k} * (s3 - s1), 9) AS shi,
         round(t1 - {k} * (t3 - t1), 9) AS tlo, round(t3 + {k} * (t3 - t1), 9) AS thi
  FROM {dst}_q),
{dst}_o AS (
  SELECT sensor, rn, bool_or(coalesce(strain < slo OR strain > shi, false)) AS so,
         bool_or(coalesce(temperature < tlo OR temperature > thi, false)) AS t_o
  FROM {dst}_m JOIN {dst}_b USING (sensor, w) GROUP BY sensor, rn),
{dst} AS (
  SELECT s.sensor, s.rn, s.time, CASE WHEN coalesce(so, false) THEN NULL ELSE strain END AS strain,
         CASE WHEN coalesce(t_o, false) THEN NULL ELSE temperature END AS temperature
  FROM {src} s LEFT JOIN {dst}_o o ON s.sensor = o.sensor AND s.rn = o.rn)"""


def sql_fill(src: str, dst: str, max_len: int) -> str:
    """CTEs that interpolate the strain gaps of ``src``."""
    return f"""
{dst}_n AS (
  SELECT *, max(CASE WHEN strain IS NOT NULL THEN rn END) OVER (PARTITION BY sensor ORDER BY rn
              ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS p,
         min(CASE WHEN strain IS NOT NULL THEN rn END) OVER (PARTITION BY sensor ORDER BY rn
              ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS f,
         count(*) OVER (PARTITION BY sensor) AS n
  FROM {src}),
{dst} AS (
  SELECT g.sensor, g.rn, g.time,
    CASE WHEN NOT hit THEN g.strain
         WHEN g.p IS NULL THEN b.strain WHEN g.f IS NULL THEN a.strain
         ELSE a.strain + (b.strain - a.strain) * (g.rn - g.p) / (g.f - g.p) END AS strain,
    CASE WHEN NOT hit THEN g.temperature
         WHEN g.p IS NULL THEN b.temperature WHEN g.f IS NULL THEN a.temperature
         ELSE a.temperature + (b.temperature - a.temperature) * (g.rn - g.p) / (g.f - g.p) END AS temperature
  FROM (SELECT *, strain IS NULL AND (p IS NOT NULL OR f IS NOT NULL)
               AND coalesce(f, n) - coalesce(p, -1) - 1 <= {max_len} AS hit FROM {dst}_n) g
  LEFT JOIN {src} a ON a.sensor = g.sensor AND a.rn = g.p
  LEFT JOIN {src} b ON b.sensor = g.sensor AND b.rn = g.f)"""


def sql_runs(src: str, dst: str, cond: str) -> str:
    """CTEs with one row per maximal run of ``cond`` in ``src``."""
    return f"""
{dst}_i AS (
  SELECT *, rn - row_number() OVER (PARTITION BY sensor ORDER BY rn) AS island FROM {src} WHERE {cond}),
{dst} AS (
  SELECT sensor, min(rn) AS start_rn, max(rn) AS end_rn, min(time) AS start_time, max(time) AS end_time,
         count(*) AS length FROM {dst}_i GROUP BY sensor, island)"""


def distributions(spark: SparkSession, sf: str) -> DataFrame:
    day = F.lit("2020-01-01 04:00:00").cast("timestamp_ntz")
    return table(spark, sf, "embeddings").select(
        "vec_id",
        (day + F.make_dt_interval(days=F.col("vec_id").cast("int"))).alias("ts"),
        F.col("embedding").cast("array<double>").alias("profile"),
        "label",
    )


DISTRIBUTIONS = """
distributions AS (
  SELECT vec_id, TIMESTAMP '2020-01-01 04:00:00' + CAST(vec_id AS INT) * INTERVAL '1' DAY AS ts,
         CAST(embedding AS DOUBLE[]) AS profile, label FROM embeddings),
cells AS (
  SELECT vec_id, ts, label, i - 1 AS i, (i - 1) * 2.5::DOUBLE AS coord, profile[i] AS strain
  FROM distributions, (SELECT unnest(range(1, 65)) AS i))"""


def grid(spark: SparkSession, sf: str) -> DataFrame:
    return joins.grid_over(table(spark, sf, "events"), "ts")


GRID = """
grid AS (
  SELECT ts, strftime(ts, '%Y%m%d%H%M%S') AS stamp FROM (
    SELECT unnest(generate_series(time_bucket(INTERVAL '4 hours', min(ts)), max(ts), INTERVAL '4 hours')) AS ts
    FROM events))"""


def file_listing(spark: SparkSession, sf: str, hours: int = 4) -> DataFrame:
    return table(spark, sf, "events").select(
        grid_floor(F.col("ts"), hours).cast("timestamp_ntz").alias("ts"),
        F.concat("event_type", F.lit(".txt")).alias("file_name"),
    )


LISTING = """
listing AS (SELECT time_bucket(INTERVAL '4 hours', ts) AS ts, event_type || '.txt' AS file_name FROM events)"""


#: the same by the hour, which leaves holes that the 4-hour grid has not
HOURLY = """
listing AS (SELECT time_bucket(INTERVAL '1 hour', ts) AS ts, event_type || '.txt' AS file_name FROM events),
grid AS (
  SELECT ts, strftime(ts, '%Y%m%d%H%M%S') AS stamp FROM (
    SELECT unnest(generate_series(time_bucket(INTERVAL '1 hour', min(ts)), max(ts), INTERVAL '1 hour')) AS ts
    FROM events))"""


def raw_readings(spark: SparkSession, sf: str) -> DataFrame:
    """Snapshots of each loop every 4 hours, with spans N10, N9, N8 and an unnumbered one."""
    user = F.col("user_id")
    rows = planted(events_numbered(spark, sf))
    span = F.when(user % 4 == 3, "End").otherwise(F.concat(F.lit("N"), (10 - user % 4).cast("string")))
    return rows.select(
        grid_floor(F.col("time")).cast("timestamp_ntz").alias("ts"),
        F.col("sensor").alias("loop"),
        F.col("event_id").alias("line"),
        span.alias("span"),
        F.lit("B").alias("beam"),
        (user % 20 * 0.5 + 1).alias("coord"),
        "strain",
        F.col("temperature").alias("temp"),
        (user % 5).cast("string").alias("position"),
    )


RAW = READINGS + """,
raw AS (
  SELECT time_bucket(INTERVAL '4 hours', r.time) AS ts, r.sensor AS loop, event_id AS line,
    CASE WHEN user_id % 4 = 3 THEN 'End' ELSE 'N' || CAST(10 - user_id % 4 AS VARCHAR) END AS span,
    'B' AS beam, (user_id % 20) * 0.5::DOUBLE + 1 AS coord, r.strain, r.temperature AS temp,
    CAST(user_id % 5 AS VARCHAR) AS position
  FROM readings r JOIN numbered b ON r.sensor = b.sensor AND r.rn = b.rn)"""


def alarm_texts(spark: SparkSession, sf: str) -> DataFrame:
    day = F.lit("2020-01-01 00:00:00").cast("timestamp_ntz")
    return table(spark, sf, "documents").select(
        (day + F.make_dt_interval(days=F.col("doc_id").cast("int"))).alias("ts"),
        F.concat_ws(" ", F.concat_ws(";", "source", "lang"), "text").alias("text"),
    )


ALARM = """
alarms AS (SELECT TIMESTAMP '2020-01-01' + CAST(doc_id AS INT) * INTERVAL '1' DAY AS ts,
                  concat_ws(' ', concat_ws(';', source, lang), text) AS text FROM documents)"""


def snapshots(spark: SparkSession, sf: str) -> DataFrame:
    """Five labelings of a growing share of the profiles; the last holds all of them."""
    base = F.lit("2021-01-01").cast("date")
    profiles = number_by_sort(table(spark, sf, "embeddings"), [], ["vec_id"], "pos")
    rows = profiles.withColumn("d", F.explode(F.sequence(F.lit(1), F.lit(5))))
    return rows.filter(5 * F.col("pos") < profiles.count() * F.col("d")).select(
        F.date_add(base, F.col("d")).alias("snapshot_date"),
        "pos",
        ((F.col("label") + F.col("vec_id") % F.col("d")) % 10).cast("int").alias("cluster"),
    )


SNAPSHOTS = """
snapshots AS (
  SELECT DATE '2021-01-01' + CAST(d AS INT) AS snapshot_date, pos, CAST((label + vec_id % d) % 10 AS INT) AS cluster
  FROM (SELECT *, row_number() OVER (ORDER BY vec_id) - 1 AS pos FROM embeddings), (SELECT unnest(range(1, 6)) AS d)
  WHERE 5 * pos < d * (SELECT count(*) FROM embeddings))"""


def errors(spark: SparkSession, sf: str) -> DataFrame:
    """Strain against its 6-row trailing mean, missing values as 0."""
    rows = rolling.rolling_mean(readings(spark, sf), window=6, out="reconstructed")
    rows = rows.select(
        "sensor",
        "rn",
        "time",
        F.coalesce("strain", F.lit(0.0)).alias("actual"),
        F.coalesce("reconstructed", F.lit(0.0)).alias("reconstructed"),
    )
    return rows.withColumn("error", F.abs(F.col("actual") - F.col("reconstructed")))


ERRORS = READINGS + """,
errors AS (
  SELECT *, abs(actual - reconstructed) AS error FROM (
    SELECT sensor, rn, time, coalesce(strain, 0.0) AS actual,
      coalesce(avg(strain) OVER (PARTITION BY sensor ORDER BY rn ROWS BETWEEN 5 PRECEDING AND CURRENT ROW), 0.0)
        AS reconstructed FROM readings))"""


def shifts(spark: SparkSession, sf: str) -> DataFrame:
    """One span per sensor that starts at the second level jump."""
    return table(spark, sf, "events").select(F.col("event_type").alias("sensor")).distinct().select(
        "sensor",
        F.lit(86).cast("long").alias("start_rn"),
        F.lit(140).cast("long").alias("end_rn"),
        F.lit(85).cast("long").alias("ref_rn"),
    )


SHIFTS = """
shifts AS (SELECT DISTINCT event_type AS sensor, 86 AS start_rn, 140 AS end_rn, 85 AS ref_rn FROM events)"""
