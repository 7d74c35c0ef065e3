"""Queries over file listings, snapshots and series summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from sensorframe import schema
from sensorframe.functions.columns import r6
from sensorframe.operators import distribution, explore, filters, joins
from sensorframe.queries import views
from sensorframe.queries.registry import query
from sensorframe.queries.views import HOURLY, ALARM, DISTRIBUTIONS, GRID, LISTING, RAW, READINGS

SENSORS = ("click", "error", "purchase", "signup", "view")


def _nonzero(spark, sf):
    return filters.zero_to_null(views.readings(spark, sf))


@query("file_counts", f"WITH {LISTING} SELECT file_name, count(*) AS n FROM listing GROUP BY file_name")
def _(spark, sf):
    return explore.file_counts(views.file_listing(spark, sf))


@query(
    "sufficient_loops",
    f"""WITH {LISTING} SELECT file_name, count(*) AS n FROM listing GROUP BY file_name
    HAVING count(*) > (SELECT count(*) / 5 FROM listing)""",
)
def _(spark, sf):
    listing = views.file_listing(spark, sf)
    return explore.sufficient_loops(listing, listing.agg(F.count(F.lit(1)) / 5).scalar())


@query("distinct_loops", f"WITH {LISTING} SELECT DISTINCT file_name FROM listing")
def _(spark, sf):
    return joins.distinct_loops(views.file_listing(spark, sf))


@query("first_per_time", f"WITH {LISTING} SELECT ts, min(file_name) AS file_name FROM listing GROUP BY ts")
def _(spark, sf):
    return joins.first_per_time(views.file_listing(spark, sf))


@query(
    "keep_loops",
    f"WITH {LISTING} SELECT * FROM listing WHERE file_name ILIKE '%Ic%' AND file_name NOT LIKE '%UR%' "
    "AND starts_with(file_name, 'cl') AND file_name IN ('click.txt', 'view.txt')",
)
def _(spark, sf):
    return filters.keep_loops(
        views.file_listing(spark, sf), ["click.txt", "view.txt"], containing="Ic", lacking="UR", starting="cl"
    )


@query(
    "merged_path",
    f"""WITH {LISTING}, m AS (SELECT *, '\\' || strftime(ts, '%Y%m%d%H%M%S') || '\\' || file_name AS merged FROM listing)
    SELECT * FROM m WHERE contains(merged, 'view.txt')""",
)
def _(spark, sf):
    return filters.merged_path(views.file_listing(spark, sf), "view.txt")


@query("time_grid", f"WITH {GRID} SELECT ts, stamp FROM grid")
def _(spark, sf):
    return views.grid(spark, sf)


@query(
    "grid_slice",
    f"WITH {GRID} SELECT ts, stamp FROM grid WHERE stamp BETWEEN '20240105040000' AND '20240110000000'",
)
def _(spark, sf):
    return filters.grid_slice(views.grid(spark, sf), "20240105040000", "20240110000000")


@query(
    "sample_times",
    f"WITH {GRID} SELECT ts, stamp FROM grid ORDER BY md5(stamp || '7') LIMIT 25",
)
def _(spark, sf):
    return joins.sample_times(views.grid(spark, sf), 25, seed=7)


@query(
    "files_present",
    f"WITH {GRID}, {LISTING} SELECT ts, stamp FROM grid WHERE ts IN (SELECT ts FROM listing WHERE file_name = 'signup.txt')",
)
def _(spark, sf):
    return joins.files_present(views.grid(spark, sf), views.file_listing(spark, sf), "signup.txt")


@query(
    "files_missing",
    f"WITH {HOURLY} SELECT ts, stamp FROM grid WHERE ts NOT IN (SELECT ts FROM listing WHERE file_name = 'error.txt')",
)
def _(spark, sf):
    grid = joins.grid_over(views.table(spark, sf, "events"), "ts", 1)
    return joins.files_missing(grid, views.file_listing(spark, sf, 1), "error.txt")


@query(
    "availability_matrix",
    f"""WITH {HOURLY}, there AS (SELECT DISTINCT ts, file_name FROM listing)
    SELECT f.file_name, g.ts, CAST(CASE WHEN e.ts IS NULL THEN 0 ELSE 1 END AS INT) AS available
    FROM (SELECT DISTINCT file_name FROM listing) f CROSS JOIN grid g
    LEFT JOIN there e ON e.ts = g.ts AND e.file_name = f.file_name""",
)
def _(spark, sf):
    listing = views.file_listing(spark, sf, 1)
    return explore.availability_matrix(
        listing, listing.agg(F.min("ts")).scalar(), listing.agg(F.max("ts")).scalar(), "1 hour"
    )


@query(
    "activity_counts",
    f"""WITH {HOURLY} SELECT t.ts, f.file_name, count(l.ts) AS n
    FROM (SELECT DISTINCT ts FROM listing) t CROSS JOIN (SELECT DISTINCT file_name FROM listing) f
    LEFT JOIN listing l ON l.ts = t.ts AND l.file_name = f.file_name GROUP BY 1, 2""",
)
def _(spark, sf):
    return explore.activity_counts(views.file_listing(spark, sf, 1))


@query(
    "extract_series",
    f"""WITH {RAW}, {GRID}, requests AS (SELECT DISTINCT loop, position FROM raw WHERE position <> '4'),
    firsts AS (SELECT ts, loop, position, first(strain ORDER BY line) AS strain, first(temp ORDER BY line) AS temp
      FROM raw GROUP BY ts, loop, position)
    SELECT q.loop, q.position, stamp AS time_index, g.ts AS time, strain, temp AS temperature
    FROM requests q CROSS JOIN (SELECT * FROM grid WHERE stamp >= '20240103000000') g
    LEFT JOIN firsts f ON f.ts = g.ts AND f.loop = q.loop AND f.position = q.position""",
)
def _(spark, sf):
    raw = views.raw_readings(spark, sf)
    requests = raw.select("loop", "position").distinct().filter("position <> '4'").select(
        F.lit("20240103000000").alias("start"), F.lit("no such time").alias("end"), "loop", "position"
    )
    listing = views.file_listing(spark, sf)
    return joins.extract_series(
        raw, requests, listing.agg(F.min("ts")).scalar(), listing.agg(F.max("ts")).scalar()
    )


@query(
    "align_on_time",
    f"""WITH {READINGS} SELECT time_bucket(INTERVAL '1 minute', time) AS time,
    {", ".join(f"first(strain ORDER BY rn) FILTER (sensor = '{s}') AS {s}" for s in SENSORS)}
    FROM nonzero GROUP BY 1""",
)
def _(spark, sf):
    minute = F.date_trunc("MINUTE", "time").cast("timestamp_ntz")
    return joins.align_on_time(_nonzero(spark, sf).withColumn("time", minute), SENSORS)


@query(
    "describe_series",
    f"""WITH {READINGS} SELECT sensor, count(strain) AS n, round(avg(strain) + 1e-9, 6) AS mean,
    round(stddev_samp(strain) + 1e-9, 6) AS std, min(strain) AS min, round(quantile_cont(strain, 0.25) + 1e-9, 6) AS q25,
    round(quantile_cont(strain, 0.5) + 1e-9, 6) AS q50, round(quantile_cont(strain, 0.75) + 1e-9, 6) AS q75, max(strain) AS max
    FROM nonzero GROUP BY sensor""",
)
def _(spark, sf):
    out = explore.describe_series(_nonzero(spark, sf))
    return out.withColumns({c: r6(c) for c in ("mean", "std", "q25", "q50", "q75")})


@query(
    "histogram",
    f"""WITH {READINGS}, e AS (SELECT sensor, min(temperature) AS lo, max(temperature) AS hi FROM readings GROUP BY sensor),
    c AS (SELECT r.sensor, CAST(least(floor((temperature - lo) / ((hi - lo) / 30)), 29) AS INT) AS bin, count(*) AS n
      FROM readings r JOIN e USING (sensor) WHERE temperature IS NOT NULL GROUP BY 1, 2)
    SELECT e.sensor, CAST(b.bin AS INT) AS bin, round(lo + b.bin * ((hi - lo) / 30) + 1e-9, 6) AS lo,
      round(lo + (b.bin + 1) * ((hi - lo) / 30) + 1e-9, 6) AS hi, coalesce(n, 0) AS n
    FROM e CROSS JOIN (SELECT unnest(range(30)) AS bin) b LEFT JOIN c ON c.sensor = e.sensor AND c.bin = b.bin""",
)
def _(spark, sf):
    out = explore.histogram(views.readings(spark, sf), "temperature", 30)
    return out.withColumn("lo", r6("lo")).withColumn("hi", r6("hi"))


@query(
    "boxplot_stats",
    f"""WITH {READINGS}, x AS (SELECT *, temperature BETWEEN q25 - 0.1 * (q75 - q25) AND q75 + 0.1 * (q75 - q25) AS inside
      FROM (SELECT sensor, temperature FROM readings WHERE temperature IS NOT NULL) r JOIN (
        SELECT sensor, quantile_cont(temperature, 0.25) AS q25, quantile_cont(temperature, 0.5) AS q50,
        quantile_cont(temperature, 0.75) AS q75 FROM readings GROUP BY sensor) USING (sensor))
    SELECT sensor, any_value(q25) AS q25, any_value(q50) AS q50, any_value(q75) AS q75,
      min(temperature) FILTER (inside) AS whisker_lo, max(temperature) FILTER (inside) AS whisker_hi,
      count(*) FILTER (NOT inside) AS outliers FROM x GROUP BY sensor""",
)
def _(spark, sf):
    return explore.boxplot_stats(views.readings(spark, sf), "temperature", 0.1)


@query(
    "pairwise_correlation",
    f"""WITH {READINGS}, m AS (SELECT sensor, time_bucket(INTERVAL '1 hour', time) AS t, avg(strain) AS strain
      FROM nonzero GROUP BY 1, 2)
    SELECT a.sensor AS sensor_a, b.sensor AS sensor_b, count(*) AS n, round(corr(a.strain, b.strain) + 1e-9, 6) + 0.0 AS corr
    FROM m a JOIN m b ON a.t = b.t AND a.sensor <= b.sensor WHERE a.strain IS NOT NULL AND b.strain IS NOT NULL
    GROUP BY 1, 2""",
)
def _(spark, sf):
    hourly = (
        _nonzero(spark, sf)
        .groupBy("sensor", F.date_trunc("HOUR", "time").alias("time"))
        .agg(F.avg("strain").alias("strain"))
    )
    out = explore.pairwise_correlation(hourly)
    return out.withColumn("corr", r6("corr"))


@query(
    "span_midpoints",
    f"WITH {RAW} SELECT span, count(*) AS n, CAST(ceil(count(*) / 2.0) AS BIGINT) AS midpoint FROM raw GROUP BY span",
)
def _(spark, sf):
    return explore.span_midpoints(views.raw_readings(spark, sf))


@query(
    "beam_coordinates",
    f"""WITH {RAW}, ext AS (SELECT ts, loop, span, min(coord) AS a, max(coord) AS b FROM raw GROUP BY 1, 2, 3),
    placed AS (SELECT *, coalesce(sum(b - a) OVER (PARTITION BY ts, loop
        ORDER BY TRY_CAST(nullif(regexp_extract(span, '\\d+'), '') AS DOUBLE) NULLS LAST, span
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off FROM ext)
    SELECT line, r.ts, r.loop, r.span, coord, round(coord - a + off + 1e-9, 6) AS beam_coord
    FROM raw r JOIN placed p ON p.ts = r.ts AND p.loop = r.loop AND p.span = r.span""",
)
def _(spark, sf):
    out = joins.beam_coordinates(views.raw_readings(spark, sf))
    return out.select("line", "ts", "loop", "span", "coord", r6("beam_coord").alias("beam_coord"))


@query(
    "distribution_matrix",
    f"""WITH {RAW} SELECT ts, coord, round(strain + 1e-9, 6) + 0.0 AS strain FROM (
      SELECT ts, coord, first(strain ORDER BY line) AS strain FROM raw WHERE loop = 'view' GROUP BY ts, coord)""",
)
def _(spark, sf):
    matrix = distribution.distribution_matrix(views.raw_readings(spark, sf), "view", coord="coord")
    return matrix.select("ts", F.inline("cells")).select("ts", "coord", r6("strain").alias("strain"))


@query(
    "alarm_matrix",
    f"""WITH {ALARM}, src AS (SELECT min(source) AS s FROM documents)
    SELECT ts, l AS loop, max(CAST(contains(text, (SELECT s FROM src) || ';' || l) AS INT)) AS flag
    FROM alarms CROSS JOIN (SELECT unnest(['de', 'en', 'es', 'fr']) AS l) GROUP BY ts, l""",
)
def _(spark, sf):
    first = views.table(spark, sf, "documents").agg(F.min("source")).first()[0]
    return explore.alarm_matrix(views.alarm_texts(spark, sf), first, ["de", "en", "es", "fr"])


@query(
    "warning_rows",
    f"""WITH {ALARM}, src AS (SELECT min(source) AS s FROM documents),
    m AS (SELECT ts, l AS loop, max(CAST(contains(text, (SELECT s FROM src) || ';' || l) AS INT)) AS flag
    FROM alarms CROSS JOIN (SELECT unnest(['de', 'en', 'es', 'fr']) AS l) GROUP BY ts, l)
    SELECT * FROM m WHERE ts IN (SELECT ts FROM m GROUP BY ts HAVING sum(flag) > 0)""",
)
def _(spark, sf):
    first = views.table(spark, sf, "documents").agg(F.min("source")).first()[0]
    matrix = explore.alarm_matrix(views.alarm_texts(spark, sf), first, ["de", "en", "es", "fr"])
    return filters.warning_rows(matrix)


@query(
    "missing_count",
    f"""WITH {READINGS} SELECT CAST(sum((strain IS NULL)::INT + (temperature IS NULL)::INT) AS BIGINT) AS missing
    FROM nonzero""",
)
def _(spark, sf):
    return explore.missing_count(_nonzero(spark, sf), ["strain", "temperature"])


@query(
    "append_rows",
    f"""WITH {LISTING} SELECT * FROM listing WHERE hour(ts) < 12 UNION ALL SELECT * FROM listing WHERE hour(ts) >= 12""",
)
def _(spark, sf):
    listing = views.file_listing(spark, sf)
    return joins.append_rows(listing.filter(F.hour("ts") < 12), listing.filter(F.hour("ts") >= 12))


@query(
    "coerce_numeric",
    "SELECT p_partkey, TRY_CAST(p_size AS DOUBLE) AS p_size, TRY_CAST(p_name AS DOUBLE) AS p_name FROM part",
)
def _(spark, sf):
    part = views.table(spark, sf, "part").select("p_partkey", F.col("p_size").cast("string").alias("p_size"), "p_name")
    return filters.coerce_numeric(part, ["p_size", "p_name"])


@query(
    "coerce_time",
    """SELECT doc_id, TRY_CAST(CASE WHEN doc_id % 3 = 0 THEN 'bad ' || doc_id
       ELSE '2020-01-01 00:00:' || lpad(CAST(doc_id % 60 AS VARCHAR), 2, '0') END AS TIMESTAMP) AS time FROM documents""",
)
def _(spark, sf):
    text = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("bad "), F.col("doc_id"))).otherwise(
        F.concat(F.lit("2020-01-01 00:00:"), F.lpad((F.col("doc_id") % 60).cast("string"), 2, "0"))
    )
    docs = views.table(spark, sf, "documents").select("doc_id", text.alias("time"))
    out = filters.coerce_time(docs, ["time"])
    return out.withColumn("time", F.col("time").cast("timestamp_ntz"))


@query(
    "with_supports",
    f"""WITH {DISTRIBUTIONS},
    pts AS (SELECT vec_id, chr(66 + label % 5) AS beam, coord, strain FROM cells),
    sup AS (SELECT * FROM (VALUES {", ".join(f"('{b}', '{s}', {c}::DOUBLE)" for b, m in schema.SUPPORT_COORDS.items() for s, c in m.items())})
            v(beam, support, at_m)),
    near AS (SELECT s.beam, support, first(coord ORDER BY abs(coord - at_m), coord) AS coord
      FROM sup s JOIN (SELECT DISTINCT beam, coord FROM pts) p ON p.beam = s.beam GROUP BY 1, 2),
    named AS (SELECT beam, coord, string_agg(support, ',' ORDER BY support) AS support FROM near GROUP BY 1, 2)
    SELECT vec_id, p.beam, p.coord, round(strain + 1e-9, 6) + 0.0 AS strain, support
    FROM pts p LEFT JOIN named n ON n.beam = p.beam AND n.coord = p.coord""",
)
def _(spark, sf):
    points = views.distributions(spark, sf).select(
        "vec_id", F.char(66 + F.col("label") % 5).alias("beam"), F.posexplode("profile").alias("i", "strain")
    )
    points = points.select("vec_id", "beam", (F.col("i") * 2.5).cast("double").alias("coord"), "strain")
    out = joins.with_supports(points, schema.supports(spark))
    return out.select("vec_id", "beam", "coord", r6("strain").alias("strain"), "support")


@query(
    "filter_coords",
    f"""WITH {DISTRIBUTIONS}, heads AS (SELECT i AS pos, CASE WHEN i = 0 THEN 'Timestamp' WHEN i % 7 = 0 THEN CAST(coord AS VARCHAR) || '.1'
       WHEN i % 5 = 0 THEN '-' || CAST(coord AS VARCHAR) ELSE CAST(coord AS VARCHAR) END AS header
      FROM (SELECT DISTINCT i, coord FROM cells))
    SELECT pos, header FROM heads WHERE pos = 0 OR (length(header) - length(replace(header, '.', '')) <= 1
      AND NOT coalesce(TRY_CAST(header AS DOUBLE) < 20, false))""",
)
def _(spark, sf):
    text = (F.col("pos") * 2.5).cast("double").cast("string")
    header = (
        F.when(F.col("pos") == 0, "Timestamp")
        .when(F.col("pos") % 7 == 0, F.concat(text, F.lit(".1")))
        .when(F.col("pos") % 5 == 0, F.concat(F.lit("-"), text))
        .otherwise(text)
    )
    coords = views.distributions(spark, sf).select(F.posexplode("profile").alias("pos", "_")).select(
        F.col("pos").cast("long").alias("pos")
    )
    return filters.filter_coords(coords.distinct().withColumn("header", header), 20)
