"""Model operators: invariants and separable data."""

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sensorframe.operators import anomaly, cluster, density, distribution, mixture, subspace
from sensorframe.queries import QUERIES


@pytest.fixture(scope="module")
def blobs(spark):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(180):
        centre = [(0, 0), (12, 0), (0, 12)][i % 3]
        x = rng.normal(centre, 0.6)
        rows.append((i, i % 3, [float(v) for v in x]))
    return spark.createDataFrame(rows, "pos long, truth int, scores array<double>").persist()


def agrees(df) -> bool:
    pairs = df.select("truth", "cluster").distinct().collect()
    return len(pairs) == 3 and len({p["cluster"] for p in pairs}) == 3


def test_separable_blobs(blobs):
    assert agrees(cluster.kmeans_clusters(blobs, 3))
    gmm = cluster.gmm_clusters(blobs, 3)
    assert gmm.filter("probability < 0.5 or probability > 1.000001").count() == 0
    model = mixture.dpgmm_fit(blobs, max_components=6, max_iter=60)
    assert agrees(mixture.dpgmm_label(blobs, model))
    assert abs(model.weights.sum() - 1) < 0.05


def test_bound_never_falls_and_repeats(blobs):
    bounds = [mixture.dpgmm_fit(blobs, max_components=5, max_iter=i, tol=0.0).bound for i in (1, 2, 4, 8, 16)]
    assert all(b >= a - 1e-6 * abs(a) for a, b in zip(bounds, bounds[1:]))
    a, b = (mixture.dpgmm_fit(blobs, max_components=5, max_iter=5) for _ in range(2))
    np.testing.assert_allclose(a.mean, b.mean, atol=1e-8)


def test_responsibilities_sum_to_one(blobs):
    model = mixture.dpgmm_fit(blobs, max_components=4, max_iter=3)
    r, _ = model.responsibilities(np.random.default_rng(0).normal(size=(50, 2)) * 10)
    np.testing.assert_allclose(r.sum(axis=1), 1)


def test_digamma():
    np.testing.assert_allclose(mixture.digamma([1.0, 0.5, 10.0]), [-0.5772156649, -1.9635100260, 2.2517525890], atol=1e-9)


LATE = 100_000  # a profile a day from 2020 on: days after 2262, which pandas does not hold


@pytest.fixture(scope="module")
def late(spark, tmp_path_factory):
    """The smallest tables with profiles of later days, as a longer table has them."""
    folder = str(tmp_path_factory.mktemp("late"))
    rows = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    rows.withColumn("vec_id", F.col("vec_id") + LATE).write.parquet(f"{folder}/embeddings.parquet")
    return folder


def test_clusters_of_late_days(spark, late):
    want = QUERIES["dpgmm_clusters"](spark, "/root/testdata/sf0.001").selectExpr(
        f"vec_id + {LATE}", f"CAST(ts + INTERVAL {LATE} DAYS AS STRING)", "cluster", "probability"
    )
    got = QUERIES["dpgmm_clusters"](spark, late).withColumn("ts", F.col("ts").cast("string"))
    assert sorted(got.collect()) == sorted(want.collect())


def test_windows_of_late_days(spark, late):
    want = QUERIES["dpgmm_windows"](spark, "/root/testdata/sf0.001").selectExpr(
        "pos", f"CAST(ts + INTERVAL {LATE} DAYS AS STRING)", "cluster", "probability"
    )
    got = QUERIES["dpgmm_windows"](spark, late).withColumn("ts", F.col("ts").cast("string"))
    assert sorted(got.collect()) == sorted(want.collect())


def test_snapshots_of_late_days(spark, late):
    want = QUERIES["dpgmm_snapshots"](spark, "/root/testdata/sf0.001").selectExpr(
        f"CAST(date_add(CAST(snapshot_date AS DATE), {LATE}) AS STRING)", "cluster", "count"
    )
    assert sorted(QUERIES["dpgmm_snapshots"](spark, late).collect()) == sorted(want.collect())


def test_labels_keep_other_columns(spark, blobs):
    model = mixture.dpgmm_fit(blobs, max_components=4, max_iter=3)
    odd = blobs.withColumn("cluster", F.lit("old")).withColumn("seen", F.expr("TIMESTAMP '9999-12-31 23:59:59.999999'"))
    got = mixture.dpgmm_label(odd.withColumn("lost", F.lit(None).cast("int")), model)
    assert got.columns == ["pos", "truth", "scores", "seen", "lost", "cluster", "probability"]
    assert got.dtypes[-2:] == [("cluster", "int"), ("probability", "double")]
    assert got.filter("seen = TIMESTAMP '9999-12-31 23:59:59.999999' AND lost IS NULL").count() == 180
    assert mixture.dpgmm_label(odd.limit(0), model).collect() == []


def test_vectors_of_a_batch():
    lists = pa.array([[9.0, 9.0], [1.0, 2.0], [3.0, None]])
    np.testing.assert_array_equal(mixture._matrix(lists.slice(1), 2), [[1, 2], [3, np.nan]])
    for odd in ([[1.0], [2.0, 3.0, 4.0]], [[1.0, 2.0], None]):
        with pytest.raises(ValueError):
            mixture._matrix(pa.array(odd), 2)


def test_window_that_ends_on_the_last_row(spark, blobs):
    dated = blobs.withColumn("ts", F.timestamp_seconds(F.col("pos") * 86400))
    labels, snaps = mixture.dpgmm_windows(
        dated, n_points=120, window=30, step=30, max_components=4, threshold=5, max_iter=10
    )
    assert labels.count() == 180 and labels.filter("cluster < 0").count() == 0
    assert agrees(labels)
    sizes = {r["n"] for r in snaps.groupBy("snapshot_date").agg(F.count("*").alias("n")).collect()}
    assert sizes == {120, 150, 180}


def test_rows_no_fit_covers(spark, blobs):
    dated = blobs.withColumn("ts", F.timestamp_seconds(F.col("pos") * 86400))
    labels, _ = mixture.dpgmm_windows(
        dated, n_points=100, window=10, step=40, max_components=3, threshold=5, max_iter=3
    )
    assert labels.count() == 180
    missing = sorted(r["pos"] for r in labels.filter("cluster = -1").collect())
    assert missing == list(range(110, 140)) + list(range(150, 180)) or missing == list(range(110, 140))


def test_quality_and_linkage(spark, blobs):
    good = cluster.cluster_quality(blobs.withColumnRenamed("truth", "cluster")).first()
    assert good["silhouette"] > 0.9 and good["davies_bouldin"] < 0.3
    one = cluster.cluster_quality(blobs.withColumn("cluster", F.lit(1))).first()
    assert one["silhouette"] is None and one["davies_bouldin"] is None
    unassigned = blobs.withColumn("cluster", F.when(F.col("truth") == 2, -1).otherwise(F.col("truth")))
    assert cluster.cluster_quality(unassigned).first()["silhouette"] > 0.9
    ids = cluster.average_linkage(np.array([[0, 1, 9], [1, 0, 8], [9, 8, 0.0]]), 2.0)
    assert ids.tolist() == [1, 1, 2]
    merged = cluster.merge_clusters(blobs.withColumn("cluster", F.col("truth") + F.lit(3) * (F.col("pos") % 2)), 20.0)
    assert agrees(merged)


def test_registry_keeps_ids(blobs):
    registry = cluster.Registry()
    first = cluster.stabilise_labels(blobs.withColumnRenamed("truth", "cluster").withColumn("truth", F.col("cluster")), registry, 3.0)
    renamed = blobs.withColumn("cluster", (F.col("truth") + 1) % 3)
    second = cluster.stabilise_labels(renamed, registry, 3.0)
    both = first.select("pos", F.col("cluster").alias("a")).join(second.select("pos", F.col("cluster").alias("b")), "pos")
    assert both.filter("a <> b").count() == 0 and registry.next_id == 3


def test_scores(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(200, 3)) @ rng.normal(size=(3, 6)) + 5
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, profile array<double>")
    s = np.stack(distribution.pca_scores(df, 3).toPandas()["scores"])
    np.testing.assert_allclose(s.mean(axis=0), 0, atol=1e-9)
    np.testing.assert_allclose(s.std(axis=0), 1, atol=1e-9)
    np.testing.assert_allclose(np.corrcoef(s.T), np.eye(3), atol=1e-8)
    share = distribution.explained_variance(df, 3).toPandas()
    values = np.sort(np.linalg.eigvalsh(np.cov(x.T)))[::-1]
    np.testing.assert_allclose(share["percent"], np.round(values / values.sum() * 100, 1)[:3], atol=0.11)


def test_reconstruction_is_exact_with_all_directions(spark):
    rng = np.random.default_rng(2)
    rows = [(s, i, None, float(rng.normal()), float(rng.normal())) for s in ("a", "b") for i in range(60)]
    df = spark.createDataFrame(rows, "sensor string, rn bigint, time timestamp, strain double, temperature double")
    train, test = anomaly.chrono_split(df, 0.4)
    whole = anomaly.reconstruction_error(train, test, ["strain", "temperature"], 4)
    part = anomaly.reconstruction_error(train, test, ["strain", "temperature"], 1)
    assert whole.count() == part.count() == 48
    assert whole.agg(F.max("error")).first()[0] < 1e-9 < part.agg(F.max("error")).first()[0]


def plain_reconstruction(train, test, k):
    """Errors by a full decomposition; both are (rows, sensors, features) with missing values as 0 after scaling."""
    x, y = (m.reshape(len(m), -1) for m in (train, test))
    centred = x - x.mean(axis=0)
    v = np.linalg.svd(centred, full_matrices=False)[2][:k].T
    return np.abs((y - x.mean(axis=0)) @ v @ v.T + x.mean(axis=0) - y).reshape(test.shape)


@pytest.mark.parametrize("sensors,rows,k", [(3, 80, 2), (40, 60, 3), (400, 90, 5)])
def test_reconstruction_against_full_decomposition(spark, sensors, rows, k):
    rng = np.random.default_rng(sensors)
    signal = rng.normal(size=(rows, k + 2)) * 3.0 ** -np.arange(k + 2)
    x = np.einsum("tk,ksf->tsf", signal, rng.normal(size=(k + 2, sensors, 2))) + rng.normal(size=(rows, sensors, 2)) * 0.05
    gone = rng.random((rows, sensors, 2)) < 0.1
    data = [
        (f"s{s:05d}", t, None, *[None if gone[t, s, f] else float(x[t, s, f]) for f in (0, 1)])
        for t in range(rows) for s in range(sensors) if t % 7 or s % 3
    ]
    df = spark.createDataFrame(data, "sensor string, rn bigint, time timestamp, strain double, temperature double")
    cut = rows * 2 // 3
    train, test = df.filter(F.col("rn") < cut), df.filter(F.col("rn") >= cut)
    got = anomaly.reconstruction_error(train, test, ["strain", "temperature"], k, outputs=["strain", "temperature"]).toPandas()

    held = np.array([[t % 7 or s % 3 for s in range(sensors)] for t in range(rows)], bool)[:, :, None]
    seen = np.where(gone | ~held, np.nan, x)
    low, high = np.nanmin(seen[:cut], axis=0), np.nanmax(seen[:cut], axis=0)
    scaled = np.nan_to_num((seen - low) / (high - low))
    want = plain_reconstruction(scaled[:cut], scaled[cut:], k)
    assert len(got) == 2 * held[cut:].sum()
    f = got["feature"].map({"strain": 0, "temperature": 1}).to_numpy()
    s = got["sensor"].str[1:].astype(int).to_numpy()
    np.testing.assert_allclose(got["error"], want[got["rn"] - cut, s, f], atol=1e-6)


def test_directions_of_very_many_columns(spark):
    rng = np.random.default_rng(4)
    columns, rows, k = 30_000, 60, 3
    x = rng.normal(size=(rows, k)) * [9, 5, 3] @ rng.normal(size=(k, columns)) + rng.normal(size=(rows, columns))
    x[rng.random(x.shape) < 0.8] = 0
    at = np.argwhere(x)
    frame = pd.DataFrame({"rn": at[:, 0], "column": at[:, 1], "x": x[at[:, 0], at[:, 1]]})
    blocks = subspace.pack(spark.createDataFrame(frame).repartition(8), columns)
    known = subspace.directions(blocks, columns, rows, k)
    u, s, v = np.linalg.svd(x - x.mean(axis=0), full_matrices=False)
    np.testing.assert_allclose(known.variances, s[:k] ** 2 / rows, rtol=1e-8)
    np.testing.assert_allclose(np.abs((known.basis * v[:k].T).sum(axis=0)), 1, atol=1e-8)
    assert known.residual < 1e-8 and abs(known.total - (s**2).sum() / rows) < 1e-6 * known.total
    shown = subspace.restored(blocks, columns, known).toPandas()
    again = (x - x.mean(axis=0)) @ v[:k].T @ v[:k] + x.mean(axis=0)
    np.testing.assert_allclose(shown["reconstructed"], again[shown["rn"], shown["column"]], atol=1e-6)


def brute_dbscan(x, eps, least):
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    near = d <= eps
    core = near.sum(1) >= least
    label = np.full(len(x), -1)
    for i in np.where(core)[0]:
        if label[i] < 0:
            stack = [i]
            label[i] = label.max() + 1
            while stack:
                j = stack.pop()
                for k in np.where(near[j] & core & (label < 0))[0]:
                    label[k] = label[i]
                    stack.append(k)
    for i in np.where(~core & (near & core).any(1))[0]:
        hosts = np.where(near[i] & core)[0]
        label[i] = label[hosts[np.lexsort((hosts, d[i][hosts]))[0]]]
    return label


@pytest.mark.parametrize(
    "eps,least,dims,rows", [(0.25, 4, 2, 1024), (0.25, 4, 2, 8), (0.6, 8, 3, 16), (1.1, 6, 10, 1024), (1.1, 6, 10, 7), (2.2, 6, 40, 16), (0.25, 1, 2, 5)]
)
def test_dbscan_against_all_pairs(spark, eps, least, dims, rows):
    rng = np.random.default_rng(5)
    centres = rng.uniform(0, 4, size=(5, dims))
    x = np.concatenate([rng.normal(c, 0.15, size=(40, dims)) for c in centres] + [rng.uniform(0, 4, (40, dims))])
    bridge = centres[0] + (centres[1] - centres[0]) * np.linspace(0, 1, 40)[:, None]
    x = np.concatenate([x, np.repeat(x[:1], 160, axis=0), bridge, centres[2] + rng.normal(0, 0.01, (300, dims))])
    data = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    odd = [(10_000, None), (10_001, [None] * dims), (10_002, [float("nan")] * dims), (10_003, [float("inf")] * dims)]
    df = spark.createDataFrame(data + odd, "vec_id long, scores array<double>").repartition(4)
    got = density.dbscan(df, eps, least, rows=rows).toPandas().sort_values("vec_id")["cluster"].to_numpy()
    want = brute_dbscan(x, eps, least)
    assert want.max() > 1 and (least == 1 or (want == -1).any())
    assert got.tolist() == [*want.tolist(), *[-1] * 4]


def test_dbscan_on_principal_scores(spark):
    sf = "/root/testdata/sf0.001"
    vectors = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", F.col("embedding").alias("profile"))
    for k in (8, 10):
        scores = distribution.pca_scores(vectors, k)
        rows = scores.orderBy("vec_id").collect()
        x = np.array([r["scores"] for r in rows])
        eps = float(np.quantile(np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1)), 0.03))
        got = density.dbscan(scores, eps, 4).orderBy("vec_id").toPandas()["cluster"]
        assert got.tolist() == brute_dbscan(x, eps, 4).tolist()


def test_dbscan_expands_no_dense_place(spark):
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(0, 1e-3, (3000, 6)), rng.uniform(-4, 4, (200, 6))])
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, scores array<double>")
    points = df.select("vec_id", F.col("scores").alias("_x"))
    ordered = density._ordered(points, density._extents(points), "vec_id").cache()
    sizes = []
    for rows in (20, 5):
        packed = density._packed(ordered, 6, rows, "vec_id").cache()
        chunks = packed.count()
        pairs, whole = density._pairs(packed.select("chunk", "n", "lo", "hi"), chunks, 6, 0.5, 5)
        settled = density._settled(whole, chunks)
        assert settled.count() > 0.7 * chunks and settled.select("group").distinct().count() == 1
        sizes.append(whole.count())
    assert sizes[1] < 4 * sizes[0] and sizes[1] < chunks**2 / 50  # four times the chunks would make 16 times the pairs


@pytest.mark.parametrize("links", [500_000, 40])
def test_components(spark, links):
    rng = np.random.default_rng(1)
    edges = [(k, k + 1) for k in range(0, 150)] + [(200, 300), (300, 250)] + [tuple(map(int, rng.integers(400, 520, 2))) for _ in range(70)]
    edges = [(max(e), min(e)) if i % 2 else e for i, e in enumerate(edges)]
    nodes = sorted({x for e in edges for x in e} | {999})
    label = {n: n for n in nodes}
    for _ in range(200):
        for u, v in edges:
            label[u] = label[v] = min(label[u], label[v])
    got = density.connected_components(
        spark.createDataFrame([(n,) for n in nodes], "node long"), spark.createDataFrame(edges, "u long, v long"), links
    )
    assert dict(map(tuple, got.collect())) == label


def test_dbscan_without_rows(spark):
    df = spark.createDataFrame([(1, None)], "vec_id long, scores array<double>")
    assert density.dbscan(df, 1.0, 1).first()["cluster"] == -1
    assert density.dbscan(df.limit(0), 1.0, 1).isEmpty()
