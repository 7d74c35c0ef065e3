"""Queries over strain profiles: outliers, directions, clusters, transitions."""

from __future__ import annotations

from pyspark.sql import functions as F

from sensorframe.functions.columns import r6
from sensorframe.operators import cluster, density, distribution, explore, joins, mixture, rolling, sankey
from sensorframe.plans.scan import number_by_time
from sensorframe.queries import views
from sensorframe.queries.registry import query
from sensorframe.queries.views import DISTRIBUTIONS, SNAPSHOTS, distributions

# A tighter fence than the default 7, so that the given profiles meet every rule.
MEAN_FENCE, VALUE_FENCE = 3.0, 3.8

_STATS = f"""{DISTRIBUTIONS},
stats AS (SELECT vec_id, avg(abs(strain)) AS abs_mean, stddev_samp(abs(strain)) AS abs_std, max(abs(strain)) AS abs_max
  FROM cells GROUP BY vec_id),
fence AS (SELECT quantile_cont(abs_mean, 0.25) AS q1, quantile_cont(abs_mean, 0.75) AS q3 FROM stats),
flags AS (SELECT vec_id,
   coalesce(abs_mean < q1 - {MEAN_FENCE} * (q3 - q1) OR abs_mean > q3 + {MEAN_FENCE} * (q3 - q1), false) AS by_mean,
   coalesce(abs_max > abs_mean + {MEAN_FENCE} * abs_std, false) AS by_row,
   coalesce(abs_max > {VALUE_FENCE} * abs_mean, false) AS by_value FROM stats, fence)"""


@query(
    "row_stats",
    f"""WITH {_STATS} SELECT vec_id, round(abs_mean + 1e-9, 6) AS abs_mean, round(abs_std + 1e-9, 6) AS abs_std,
    round(abs_max + 1e-9, 6) AS abs_max FROM stats""",
)
def _(spark, sf):
    out = distribution.row_stats(distributions(spark, sf))
    return out.select("vec_id", *[r6(c).alias(c) for c in ("abs_mean", "abs_std", "abs_max")])


@query("outlier_flags", f"WITH {_STATS} SELECT * FROM flags")
def _(spark, sf):
    out = distribution.outlier_flags(distributions(spark, sf), MEAN_FENCE, VALUE_FENCE)
    return out.select("vec_id", "by_mean", "by_row", "by_value")


@query(
    "row_outliers",
    f"""WITH {_STATS} SELECT vec_id, d.ts, d.label FROM distributions d JOIN flags USING (vec_id)
    WHERE NOT (by_mean OR by_row OR by_value)""",
)
def _(spark, sf):
    return distribution.row_outliers(distributions(spark, sf), MEAN_FENCE, VALUE_FENCE).select("vec_id", "ts", "label")


@query(
    "row_outliers_zscore",
    f"""WITH {_STATS}, whole AS (SELECT avg(abs_mean) AS m, stddev_samp(abs_mean) AS s FROM stats)
    SELECT vec_id FROM stats, whole WHERE NOT (abs(abs_mean - m) > 2.5 * s OR abs_max > abs_mean + 2.5 * abs_std)""",
)
def _(spark, sf):
    return distribution.row_outliers_zscore(distributions(spark, sf), 2.5).select("vec_id")


@query("outlier_union", f"WITH {_STATS} SELECT vec_id FROM flags WHERE by_mean OR by_row OR by_value")
def _(spark, sf):
    return distribution.outlier_union(distributions(spark, sf), MEAN_FENCE, VALUE_FENCE)


@query(
    "rows_except",
    f"""WITH {_STATS} SELECT vec_id, ts FROM distributions
    WHERE vec_id NOT IN (SELECT vec_id FROM flags WHERE by_mean OR by_row OR by_value)""",
)
def _(spark, sf):
    rows = distributions(spark, sf)
    out = joins.rows_except(rows, distribution.outlier_union(rows, MEAN_FENCE, VALUE_FENCE), ["vec_id"])
    return out.select("vec_id", "ts")


@query("cluster_sizes", "SELECT label, count(*) AS n FROM embeddings GROUP BY label")
def _(spark, sf):
    return explore.cluster_sizes(distributions(spark, sf), "label")


@query(
    "cluster_profiles",
    f"""WITH {DISTRIBUTIONS}, p AS (SELECT label, coord, avg(strain) AS mean, stddev_samp(strain) AS std
      FROM cells GROUP BY 1, 2),
    a AS (SELECT label, avg(std) AS avg_std FROM p GROUP BY label)
    SELECT label, coord, round(mean + 1e-9, 6) + 0.0 AS mean, round(std + 1e-9, 6) AS std, round(mean - std + 1e-9, 6) + 0.0 AS lower,
      round(mean + std + 1e-9, 6) + 0.0 AS upper, round(avg_std + 1e-9, 6) AS avg_std FROM p JOIN a USING (label)""",
)
def _(spark, sf):
    out = distribution.cluster_profiles(distributions(spark, sf), label="label")
    return out.select(
        "label", F.col("coord").cast("double").alias("coord"),
        *[r6(c).alias(c) for c in ("mean", "std", "lower", "upper", "avg_std")],
    )


@query(
    "cluster_timeline",
    f"""WITH {DISTRIBUTIONS} SELECT date_trunc('month', ts)::TIMESTAMP AS month, label, count(*) AS n
    FROM distributions GROUP BY 1, 2 ORDER BY 1, 2""",
)
def _(spark, sf):
    rows = distributions(spark, sf).withColumn("month", F.date_trunc("MONTH", "ts").cast("timestamp_ntz"))
    return explore.cluster_timeline(rows, "month", "label")


@query(
    "label_agreement",
    """SELECT CASE WHEN label = five AND label = ten THEN 'all' WHEN label = five THEN 'label=five'
    WHEN label = ten THEN 'label=ten' WHEN five = ten THEN 'five=ten' ELSE 'none' END AS agreement, count(*) AS n
    FROM (SELECT label, label % 5 AS five, vec_id % 10 AS ten FROM embeddings) GROUP BY 1""",
)
def _(spark, sf):
    rows = distributions(spark, sf).select(
        "label", (F.col("label") % 5).alias("five"), (F.col("vec_id") % 10).alias("ten")
    )
    return explore.label_agreement(rows, "label", "five", "ten")


@query(
    "label_confidence",
    f"""WITH {DISTRIBUTIONS} SELECT vec_id, round(avg(abs(profile[1])) OVER (ORDER BY ts
    ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) + 1e-9, 6) AS confidence FROM distributions""",
)
def _(spark, sf):
    rows = distributions(spark, sf).select(
        "vec_id", "ts", F.abs(F.col("profile")[0]).alias("probability"), F.lit("all").alias("sensor")
    )
    rows = number_by_time(rows, time="ts", ties=["vec_id"])
    out = rolling.label_confidence(rows, "probability", 7, ["sensor"])
    return out.select("vec_id", r6("confidence").alias("confidence"))


@query("explained_variance")
def _(spark, sf):
    return distribution.explained_variance(distributions(spark, sf), 10)


@query(
    "pca_scores",
    """SELECT CAST(i AS INT) AS component, CAST((SELECT count(*) FROM embeddings) AS BIGINT) AS n, 0.0::DOUBLE AS mean,
    1.0::DOUBLE AS std, 0.0::DOUBLE AS corr_next FROM (SELECT unnest(range(0, 8)) AS i)""",
)
def _(spark, sf):
    """What defines the scores: centred, unit deviation, uncorrelated."""
    scores = distribution.pca_scores(distributions(spark, sf), 8)
    cells = scores.select(
        F.posexplode("scores").alias("component", "a"),
        F.concat(F.slice("scores", 2, 7), F.slice("scores", 1, 1)).alias("shifted"),
    ).withColumn("b", F.get("shifted", "component"))
    return cells.groupBy("component").agg(
        F.count(F.lit(1)).alias("n"),
        r6(F.avg("a")).alias("mean"),
        r6(F.stddev_pop("a")).alias("std"),
        r6(F.corr("a", "b")).alias("corr_next"),
    )


def _scores(spark, sf, k=8):
    return distribution.pca_scores(distributions(spark, sf), k).select("vec_id", "ts", "scores", "label")


@query("kmeans_clusters")
def _(spark, sf):
    return cluster.kmeans_clusters(_scores(spark, sf), 6).select("vec_id", "ts", "cluster")


@query("gmm_clusters")
def _(spark, sf):
    out = cluster.gmm_clusters(_scores(spark, sf), 4)
    return out.select("vec_id", "ts", "cluster", r6("probability").alias("probability"))


_PLANE = """
plane AS (SELECT label AS cluster, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y FROM embeddings),
moments AS (SELECT cluster, count(*) AS n, avg(x) AS mx, avg(y) AS my, var_pop(x) AS xx, covar_pop(x, y) AS xy,
  var_pop(y) AS yy FROM plane GROUP BY cluster)"""


def _plane(spark, sf):
    return distributions(spark, sf).select(
        "vec_id", F.col("label").alias("cluster"), F.slice("profile", 1, 2).alias("scores")
    )


@query(
    "component_moments",
    f"""WITH {_PLANE} SELECT cluster, n, round(mx + 1e-9, 6) + 0.0 AS mx, round(my + 1e-9, 6) + 0.0 AS my, round(xx + 1e-9, 6) AS xx,
    round(xy + 1e-9, 6) + 0.0 AS xy, round(yy + 1e-9, 6) AS yy FROM moments""",
)
def _(spark, sf):
    out = cluster.component_moments(_plane(spark, sf))
    return out.select(
        "cluster",
        "n",
        r6(F.col("mean")[0]).alias("mx"),
        r6(F.col("mean")[1]).alias("my"),
        r6(F.col("cov")[0]).alias("xx"),
        r6(F.col("cov")[1]).alias("xy"),
        r6(F.col("cov")[3]).alias("yy"),
    )


_DIVERGE = f"""{_PLANE}, c AS (SELECT *, xx * yy - xy * xy AS det FROM moments),
    kls AS (SELECT p.cluster AS a, q.cluster AS b,
      0.5 * ((q.yy * p.xx - 2 * q.xy * p.xy + q.xx * p.yy) / q.det
        + (q.yy * (q.mx - p.mx) ** 2 - 2 * q.xy * (q.mx - p.mx) * (q.my - p.my) + q.xx * (q.my - p.my) ** 2) / q.det
        - 2 + ln(q.det / p.det)) AS kl FROM c p JOIN c q ON p.cluster <> q.cluster),
    pairs AS (SELECT f.a, f.b, 0.5 * (f.kl + r.kl) AS j FROM kls f JOIN kls r ON f.a = r.b AND f.b = r.a WHERE f.a < f.b)"""


@query(
    "gaussian_divergence",
    f"""WITH {_DIVERGE} SELECT CAST(f.a AS BIGINT) AS a, CAST(f.b AS BIGINT) AS b, round(f.kl + 1e-9, 6) AS kl_ab,
    round(r.kl + 1e-9, 6) AS kl_ba, round(0.5 * (f.kl + r.kl) + 1e-9, 6) AS jeffreys
    FROM kls f JOIN kls r ON f.a = r.b AND f.b = r.a WHERE f.a < f.b""",
)
def _(spark, sf):
    out = cluster.gaussian_divergence(cluster.component_moments(_plane(spark, sf)))
    return out.select("a", "b", *[r6(c).alias(c) for c in ("kl_ab", "kl_ba", "jeffreys")])


@query(
    "merge_clusters",
    f"""WITH {_DIVERGE}, best AS (SELECT a, b FROM pairs ORDER BY j LIMIT 1),
    joined AS (SELECT vec_id, CASE WHEN label = b THEN a ELSE label END AS g FROM embeddings, best)
    SELECT vec_id, CAST(dense_rank() OVER (ORDER BY g) AS INT) AS cluster FROM joined""",
)
def _(spark, sf):
    """The threshold lies between the two closest pairs, so exactly one pair is joined."""
    rows = _plane(spark, sf)
    closest = cluster.gaussian_divergence(cluster.component_moments(rows), ridge=1e-6).orderBy("jeffreys").limit(2)
    threshold = closest.agg(F.avg("jeffreys")).first()[0]
    return cluster.merge_clusters(rows, threshold).select("vec_id", "cluster")


@query(
    "stabilise_labels",
    """SELECT vec_id, CAST(dense_rank() OVER (ORDER BY label) - 1 AS INT) AS first,
    CAST(dense_rank() OVER (ORDER BY label) - 1 AS INT) AS second FROM embeddings""",
)
def _(spark, sf):
    """A second clustering with other labels for the same components gets the first one's ids."""
    registry = cluster.Registry()
    first = cluster.stabilise_labels(_plane(spark, sf), registry, 1e-4)
    second = _plane(spark, sf).withColumn("cluster", (F.col("cluster") + 3) % 10)
    second = cluster.stabilise_labels(second, registry, 1e-4)
    return first.select("vec_id", F.col("cluster").alias("first")).join(
        second.select("vec_id", F.col("cluster").alias("second")), "vec_id"
    )


@query(
    "match_components",
    """SELECT CAST(label AS BIGINT) AS cluster, CAST(row_number() OVER (ORDER BY label) - 1 AS INT) AS global_id
    FROM (SELECT DISTINCT label FROM embeddings)""",
)
def _(spark, sf):
    return cluster.match_components(cluster.component_moments(_plane(spark, sf)), cluster.Registry(), 1e-4)


_BOULDIN = f"""{DISTRIBUTIONS}, c AS (SELECT label, i, avg(strain) AS m FROM cells GROUP BY 1, 2),
    s AS (SELECT label, avg(r) AS s FROM (SELECT x.label, vec_id, sqrt(sum((strain - m) ** 2)) AS r
      FROM cells x JOIN c ON c.label = x.label AND c.i = x.i GROUP BY 1, 2) GROUP BY label),
    d AS (SELECT a.label AS a, b.label AS b, sqrt(sum((a.m - b.m) ** 2)) AS d FROM c a JOIN c b
      ON a.i = b.i AND a.label <> b.label GROUP BY 1, 2),
    w AS (SELECT d.a, max((sa.s + sb.s) / d.d) AS worst FROM d JOIN s sa ON sa.label = d.a JOIN s sb ON sb.label = d.b
      GROUP BY d.a)"""


@query("davies_bouldin", f"WITH {_BOULDIN} SELECT round(avg(worst) + 1e-9, 6) AS davies_bouldin FROM w")
def _(spark, sf):
    out = cluster.davies_bouldin(distributions(spark, sf), "profile", "label")
    return out.select(r6("davies_bouldin").alias("davies_bouldin"))


@query(
    "cluster_quality",
    f"""WITH {_BOULDIN}, gaps AS (SELECT x.vec_id, x.label AS own, y.label AS other,
        avg(list_distance(x.profile, y.profile) ** 2) AS far
      FROM distributions x JOIN distributions y ON x.vec_id <> y.vec_id GROUP BY 1, 2, 3),
    sides AS (SELECT vec_id, min(far) FILTER (own = other) AS a, min(far) FILTER (own <> other) AS b
      FROM gaps GROUP BY vec_id)
    SELECT (SELECT round(avg((b - a) / greatest(a, b)) + 1e-9, 6) + 0.0 FROM sides) AS silhouette,
           (SELECT round(avg(worst) + 1e-9, 6) + 0.0 FROM w) AS davies_bouldin""",
)
def _(spark, sf):
    out = cluster.cluster_quality(distributions(spark, sf), "profile", "label")
    return out.select(r6("silhouette").alias("silhouette"), r6("davies_bouldin").alias("davies_bouldin"))


@query("cluster_sweep")
def _(spark, sf):
    return cluster.cluster_sweep(_scores(spark, sf, 4).select("vec_id", "scores"), 3)


_EPS, _LEAST = 1.1, 3


@query(
    "dbscan",
    f"""WITH RECURSIVE p AS (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings),
    near AS (SELECT a.vec_id AS a, b.vec_id AS b, list_distance(a.x, b.x) AS d FROM p a JOIN p b
      ON list_distance(a.x, b.x) <= {_EPS}::DOUBLE),
    core AS (SELECT a AS id FROM near GROUP BY a HAVING count(*) >= {_LEAST}),
    walk AS (SELECT id, id AS root FROM core
      UNION SELECT n.b, w.root FROM walk w JOIN near n ON n.a = w.id JOIN core c ON c.id = n.b),
    comp AS (SELECT id, min(root) AS root FROM walk GROUP BY id),
    border AS (SELECT a AS id, first(root ORDER BY d, b) AS root FROM near JOIN comp ON comp.id = b
      WHERE a NOT IN (SELECT id FROM core) GROUP BY a),
    named AS (SELECT * FROM comp UNION ALL SELECT * FROM border),
    ids AS (SELECT root, row_number() OVER (ORDER BY root) - 1 AS cluster
            FROM (SELECT root, min(id) AS m FROM comp GROUP BY root))
    SELECT p.vec_id, CAST(coalesce(cluster, -1) AS INT) AS cluster FROM p LEFT JOIN named n ON n.id = p.vec_id
    LEFT JOIN ids USING (root)""",
)
def _(spark, sf):
    return density.dbscan(distributions(spark, sf), _EPS, _LEAST, features="profile").select("vec_id", "cluster")


@query("dpgmm_clusters")
def _(spark, sf):
    out = mixture.dpgmm_clusters(_scores(spark, sf, 4), max_components=8, max_iter=25)
    return out.select("vec_id", "ts", "cluster", r6("probability").alias("probability"))


def _windows(spark, sf):
    """Four fits over the whole history, whatever its length."""
    rows = _scores(spark, sf, 3).withColumn("sensor", F.lit("beam"))
    rows = number_by_time(rows, time="ts", ties=["vec_id"], out="pos")
    n = rows.count()
    return mixture.dpgmm_windows(
        rows, n_points=n // 2, window=n // 6, step=n // 8, max_components=5, threshold=2, max_iter=8
    )


@query("dpgmm_windows")
def _(spark, sf):
    labels, _ = _windows(spark, sf)
    return labels.select("pos", "ts", "cluster", r6("probability").alias("probability"))


@query("dpgmm_snapshots")
def _(spark, sf):
    _, snaps = _windows(spark, sf)
    return snaps.groupBy(snaps.snapshot_date.cast("string").alias("snapshot_date"), "cluster").count()


_LINKS = f"""{SNAPSHOTS},
dates AS (SELECT snapshot_date AS d, lead(snapshot_date) OVER (ORDER BY snapshot_date) AS nd
  FROM (SELECT DISTINCT snapshot_date FROM snapshots)),
links AS (SELECT strftime(d, '%Y-%m-%d') || '_Cluster: ' || a.cluster AS source_name,
    strftime(nd, '%Y-%m-%d') || '_Cluster: ' || b.cluster AS target_name, count(*) AS value
  FROM dates JOIN snapshots a ON a.snapshot_date = d JOIN snapshots b ON b.snapshot_date = nd AND a.pos = b.pos
  GROUP BY 1, 2),
names AS (SELECT source_name AS name FROM links UNION SELECT target_name FROM links),
nodes AS (SELECT name, CAST(row_number() OVER (ORDER BY name) - 1 AS INT) AS id FROM names)"""


@query("cluster_transitions", f"WITH {_LINKS} SELECT * FROM links")
def _(spark, sf):
    return sankey.cluster_transitions(views.snapshots(spark, sf))


@query("sankey_nodes", f"WITH {_LINKS} SELECT name, id FROM nodes")
def _(spark, sf):
    return sankey.sankey_nodes(sankey.cluster_transitions(views.snapshots(spark, sf)))


@query(
    "sankey_links",
    f"""WITH {_LINKS} SELECT s.id AS source, t.id AS target, value FROM links
    JOIN nodes s ON s.name = source_name JOIN nodes t ON t.name = target_name""",
)
def _(spark, sf):
    links = sankey.cluster_transitions(views.snapshots(spark, sf))
    return sankey.sankey_links(links, sankey.sankey_nodes(links))


@query(
    "sankey_positions",
    f"""WITH {_LINKS}, parts AS (SELECT *, split_part(name, '_', 1) AS t, split_part(name, '_', 2) AS c FROM nodes)
    SELECT name, id, round((dense_rank() OVER (ORDER BY t) - 1)::DOUBLE / (SELECT count(DISTINCT t) - 1 FROM parts) + 1e-9, 6) AS x,
    round((dense_rank() OVER (ORDER BY c) - 1)::DOUBLE / (SELECT count(DISTINCT c) FROM parts) + 1e-9, 6) AS y FROM parts""",
)
def _(spark, sf):
    links = sankey.cluster_transitions(views.snapshots(spark, sf))
    out = sankey.sankey_positions(sankey.sankey_nodes(links))
    return out.select("name", "id", r6("x").alias("x"), r6("y").alias("y"))


@query(
    "snapshot_every",
    f"""WITH {SNAPSHOTS}, d AS (SELECT snapshot_date, row_number() OVER (ORDER BY snapshot_date) - 1 AS i
      FROM (SELECT DISTINCT snapshot_date FROM snapshots))
    SELECT CAST(snapshot_date AS VARCHAR) AS snapshot_date, pos, cluster FROM snapshots JOIN d USING (snapshot_date)
    WHERE i % 3 = 0""",
)
def _(spark, sf):
    out = sankey.snapshot_every(views.snapshots(spark, sf), 3)
    return out.select(F.col("snapshot_date").cast("string").alias("snapshot_date"), "pos", "cluster")
