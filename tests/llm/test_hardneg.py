"""Hard negatives against brute force, and the bounds along spanning trees."""

import math
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sensorframe.llm import hardneg
from sensorframe.llm.queries import ORACLES, QUERIES
from tests.compare import connect, difference

SCHEMA = "vec_id long, embedding array<double>, label int, _rid int, _n string"
END = (1 << 63) - 1


def plain(rows, positives=5, negatives=3):
    usable = []
    for k, (i, v, label) in enumerate(rows):
        if label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            q = [math.floor(256 * x) if abs(x) < 1e300 else int(x) * 256 for x in v]
            usable.append((k, END if i is None else i, label, q))
    out = []
    for a in usable:
        if a[1] % 50 or a[1] == END:
            continue
        scored = [(-sum(x * y for x, y in zip(a[3], b[3])), b[1], b[2]) for b in usable if b[0] != a[0] and len(b[3]) == len(a[3])]
        for p, pid, _ in sorted(s for s in scored if s[2] == a[2])[:positives]:
            fit = sorted(s for s in scored if s[2] != a[2] and 50 * -p <= 100 * -s[0] <= 95 * -p)[:negatives]
            for rank, (n, nid, _) in enumerate(fit, 1):
                held = [max(-END, min(END, -x)) for x in (p, n)]
                out.append((a[1], None if pid == END else pid, rank, None if nid == END else nid, *held))
    return Counter(out)


def vectors(kind: str):
    rng = np.random.default_rng(7)
    n, d = 500, 6
    if kind == "random":
        x = rng.normal(size=(n, d))
    elif kind == "clusters":
        x = rng.normal(size=(8, d))[rng.integers(0, 8, n)] * 3 + rng.normal(size=(n, d)) * 0.02
    else:  # ties: few different vectors, zeros among them
        x = rng.integers(-1, 2, (n, d)) * 0.5
    rows = [(k, v.tolist(), int(rng.integers(0, 3))) for k, v in enumerate(x)]
    rows += [rows[50], rows[50], rows[7], (None, rows[3][1], 1), (None, rows[100][1], 0), (600, None, 1), (650, [1.0] * d, None)]
    rows += [(700, [float("nan")] * d, 1), (750, [float("inf")] + [0.0] * (d - 1), 1), (800, [None] * d, 0), (-50, [1.0] * d, 1)]
    rows += [(850, [1.0, 2.0], 1), (851, [1.0, 2.5], 1), (852, [1.0, 1.1], 0), (900, [], 1), (901, [], 1), (902, [], 2)]
    return rows


@pytest.mark.parametrize("kind", ["random", "clusters", "ties"])
def test_hard_negatives(spark, kind):
    rows = vectors(kind)
    df = spark.createDataFrame([(*r, 1, "clash") for r in rows], SCHEMA).repartition(3)
    want = plain(rows)
    assert len(want) > 20
    for sizes in ({}, {"tree": 4, "group": 8, "block": 60}):
        got = hardneg.mine(df, F.col("vec_id") % 50 == 0, **sizes)
        assert Counter(map(tuple, got.collect())) == want


def test_large_components(spark):
    rows = [(k, [x, 1.0], k % 2) for k, x in enumerate([2e6, 1.5e6, 1e6, -2e6, 3e6, 1e4] * 4)] + [(50, [2.5e6, -1.0], 0), (100, [2e5, 1.0], 0)]
    df = spark.createDataFrame([(*r, 1, "") for r in rows], SCHEMA)
    got = hardneg.mine(df, F.col("vec_id") % 50 == 0)
    assert Counter(map(tuple, got.collect())) == plain(rows)
    huge = spark.createDataFrame([(150, [1e308, 1.0], 0, 1, "")], SCHEMA)
    assert hardneg.mine(df.union(huge), F.col("vec_id") % 50 == 0).count() > 0


def test_no_rows(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert hardneg.mine(df, F.col("vec_id") % 50 == 0).isEmpty()


def test_spanning_tree_is_minimal():
    points = np.random.default_rng(1).normal(size=(40, 3))
    parent, edge, turn = hardneg.spanning_tree(points)
    gap = np.linalg.norm(points[:, None] - points[None], axis=2)
    joined, total = {0}, 0.0
    while len(joined) < 40:  # Prim's rule, from another point
        w, j = min((gap[a, b], b) for a in joined for b in range(40) if b not in joined)
        total, joined = total + w, joined | {j}
    assert math.isclose(edge.sum(), total) and (parent < 0).sum() == 1
    assert sorted(turn) == list(range(40)) and all(turn[p] < turn[i] for i, p in enumerate(parent) if p >= 0)
    assert all(math.isclose(edge[i], gap[i, p]) for i, p in enumerate(parent) if p >= 0)


def test_near_anchors_save_products():
    rng = np.random.default_rng(2)
    centre = rng.normal(size=8)
    anchors = centre + rng.normal(size=(50, 8)) * 0.001
    others = rng.normal(size=(2000, 8))
    table = pa.table({"_dim": [8] * 50, "_rid": range(50), "_label": [0] * 50, "_vec": anchors.tolist(), "_pos": range(50), "_id": range(50)})
    table = hardneg._spanned(256.0)(table)
    found = pa.table({"_vec": others.tolist(), "_rid": range(100, 2100)})
    bounds = hardneg.Bounds(table, found, 256.0)
    exact = np.floor(256 * others) @ np.floor(256 * anchors).T
    for i, at, score in bounds.walk(lambda i, low, high: np.flatnonzero((high >= 100_000) & (low <= 120_000))):
        own = exact[:, bounds.anchors["_rid"][i].as_py()]
        inside = np.flatnonzero((own >= 100_000) & (own <= 120_000))
        assert set(inside) <= set(at) and (score == own[at]).all()
    assert bounds.scored < 0.3 * 50 * 2000


def test_sql_gives_the_same_rows(spark):
    sf = "/root/testdata/sf0.001"
    got = QUERIES["op13_hard_negatives"](spark, sf).toPandas()
    assert difference(got, connect(sf).execute(ORACLES["op13_hard_negatives"]).df()) is None
