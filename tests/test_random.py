"""Operators with tiny chunks against plain loops, many random series at a time."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sensorframe.functions.quantiles import bracketed_quantiles, exact_quantiles
from sensorframe.operators import anomaly, cleaning, explore, regions, rolling
from sensorframe.plans import scan
from sensorframe.plans.sizing import attach

SIZE = 20


def make_series(seed: int, count: int = 40, longest: int = 170) -> pd.DataFrame:
    rng = np.random.default_rng(seed)
    rows = []
    for s in range(count):
        n = int(rng.integers(1, longest))
        level, gap = 0.0, 0
        for rn in range(n):
            if gap == 0 and rng.random() < 0.08:
                gap = int(rng.integers(1, 8 if rng.random() < 0.8 else 30))
            if rng.random() < 0.03:
                level += rng.normal(0, 60)
            strain = None if gap else round(level + rng.normal(0, 3), 2)
            if strain is not None and rng.random() < 0.03:
                strain = 0.0
            if strain is not None and rng.random() < 0.02:
                strain += 900.0
            gap = max(gap - 1, 0)
            temp = None if rng.random() < 0.1 else round(rng.normal(10, 4), 2)
            rows.append((f"s{s:03d}", rn, pd.Timestamp("2020-01-01") + pd.Timedelta(hours=4 * rn), strain, temp))
    return pd.DataFrame(rows, columns=["sensor", "rn", "time", "strain", "temperature"])


LAYOUT = "sensor string, rn bigint, time timestamp, strain double, temperature double"


def to_spark(spark, pdf):
    floats = pdf.astype({"strain": float, "temperature": float})
    return spark.createDataFrame(floats, LAYOUT).replace(float("nan"), None)


@pytest.fixture(scope="module", params=[1, 2])
def data(spark, request):
    pdf = make_series(request.param)
    df = to_spark(spark, pdf).persist()
    return pdf, df


def per_sensor(pdf):
    for name, g in pdf.groupby("sensor"):
        yield name, g.reset_index(drop=True)


def same(got, want, cols=("strain", "temperature")):
    got = got.sort_values(["sensor", "rn"], ignore_index=True)
    want = want.sort_values(["sensor", "rn"], ignore_index=True)
    assert len(got) == len(want)
    for c in cols:
        np.testing.assert_allclose(got[c].astype(float), want[c].astype(float), rtol=1e-9, atol=1e-6)


def loop_clean(g, k, window, step):
    strain = g["strain"].astype(float).where(g["strain"] != 0)
    temp = g["temperature"].astype(float)
    bad = {"s": set(), "t": set()}
    for start in range(0, len(g) - window + 1, step):
        for key, col in (("s", strain), ("t", temp)):
            part = col.iloc[start : start + window]
            q1, q3 = part.quantile(0.25), part.quantile(0.75)
            lo, hi = round(q1 - k * (q3 - q1), 9), round(q3 + k * (q3 - q1), 9)
            bad[key] |= set(part[(part < lo) | (part > hi)].index)
    out = g.copy()
    out["strain"] = strain.where(~strain.index.isin(bad["s"]))
    out["temperature"] = temp.where(~temp.index.isin(bad["t"]))
    return out


def loop_runs(flags):
    found, start = [], None
    for i, f in enumerate(list(flags) + [False]):
        if f and start is None:
            start = i
        if not f and start is not None:
            found.append((start, i - 1))
            start = None
    return found


def loop_fill(g, limit):
    out = g.copy()
    out[["strain", "temperature"]] = out[["strain", "temperature"]].astype(float)
    src = out.copy()
    for a, b in loop_runs(src["strain"].isna()):
        if b - a + 1 > limit:
            continue
        for c in ("strain", "temperature"):
            for i in range(a, b + 1):
                if a > 0 and b + 1 < len(src):
                    u, v = src[c][a - 1], src[c][b + 1]
                    out.loc[i, c] = u + (v - u) * (i - a + 1) / (b - a + 2)
                elif a > 0:
                    out.loc[i, c] = src[c][a - 1]
                elif b + 1 < len(src):
                    out.loc[i, c] = src[c][b + 1]
    return out


def loop_rebase(g, k, n_prev, n_curr, min_region):
    v = g["strain"].astype(float).to_numpy().copy()
    found = loop_runs(~np.isnan(v))
    shift = 0.0
    for i in range(1, len(found)):
        (a, b), (c, d) = found[i - 1], found[i]
        v[c : d + 1] += shift
        tail = v[max(a, b - n_prev + 1) : b + 1]
        base = tail
        if b - a + 1 < min_region and i > 1:
            e, f = found[i - 2]
            base = v[max(e, f - n_prev + 1) : f + 1]
        sd = np.std(base, ddof=1) if len(base) > 1 else np.nan
        head = v[c : min(d, c + n_curr - 1) + 1].mean()
        delta = tail.mean() - head if head < tail.mean() - k * sd or head > tail.mean() + k * sd else 0.0
        v[c : d + 1] += delta
        shift += delta
    out = g.copy()
    out["strain"] = v
    return out


@pytest.mark.parametrize("k,window,step", [(3, 40, 20), (1.5, 30, 20), (2, 20, 7)])
def test_clean(data, k, window, step):
    pdf, df = data
    got = cleaning.clean_zeros_outliers(df, k, window, step, size=SIZE).toPandas()
    same(got, pd.concat([loop_clean(g, k, window, step) for _, g in per_sensor(pdf)]))


@pytest.mark.parametrize("limit", [1, 5, 20, 60])
def test_interpolate(data, limit):
    pdf, df = data
    got = cleaning.interpolate_gaps(df, limit, size=SIZE).toPandas()
    same(got, pd.concat([loop_fill(g, limit) for _, g in per_sensor(pdf)]))


def test_preprocess(data):
    pdf, df = data
    got = cleaning.preprocess(df, 6, 3, 40, 20, size=SIZE).toPandas()
    same(got, pd.concat([loop_fill(loop_clean(g, 3, 40, 20), 6) for _, g in per_sensor(pdf)]))


@pytest.mark.parametrize("missing", [True, False])
def test_regions(data, missing):
    pdf, df = data
    find = regions.gap_regions if missing else regions.valid_regions
    got = find(df, 1, size=SIZE).toPandas().sort_values(["sensor", "start_rn"])
    want = [
        (name, a, b, g["time"][a], g["time"][b], b - a + 1)
        for name, g in per_sensor(pdf)
        for a, b in loop_runs(g["strain"].isna() == missing)
    ]
    assert [tuple(r) for r in got.itertuples(index=False)] == want


@pytest.mark.parametrize("k", [0.5, 4.6])
def test_rebaseline(data, k):
    pdf, df = data
    got = regions.rebaseline_regions(df, k, 6, 4, 3, size=SIZE).toPandas()
    same(got, pd.concat([loop_rebase(g, k, 6, 4, 3) for _, g in per_sensor(pdf)]))


def test_center(data):
    pdf, df = data
    got = regions.center_regions(df, size=SIZE).toPandas()
    parts = []
    for _, g in per_sensor(pdf):
        out = g.copy()
        out["strain"] = out["strain"].astype(float)
        for a, b in loop_runs(out["strain"].notna()):
            out.loc[a:b, "strain"] -= out.loc[a:b, "strain"].mean()
        parts.append(out)
    same(got, pd.concat(parts))


def test_overlap(spark, data):
    pdf, df = data
    names = sorted(pdf["sensor"].unique())[:3]
    lists = {n: loop_runs(g["strain"].notna()) for n, g in per_sensor(pdf) if n in names}
    found = lists[names[0]]
    for n in names[1:]:
        found = [(max(a, c), min(b, d)) for a, b in found for c, d in lists[n] if max(a, c) <= min(b, d)]
    rows = regions.valid_regions(df.filter(F.col("sensor").isin(names)), 1, size=SIZE)
    got = regions.overlapping_regions(rows, 1, size=SIZE).toPandas()
    assert sorted(map(tuple, got.to_numpy().tolist())) == [(a, b) for a, b in found if b - a >= 1]


@pytest.mark.parametrize("mode,n,least", [(1, 3, 1), (2, 3, 4), (3, 5, 3)])
def test_anomaly_points(data, mode, n, least):
    pdf, df = data
    errors = df.select("sensor", "rn", "time", F.abs(F.coalesce("strain", F.lit(0.0))).alias("error"))
    got = anomaly.anomaly_points(errors, 20.0, mode, n, least, size=SIZE).select("sensor", "rn").toPandas()
    want = []
    for name, g in per_sensor(pdf):
        e = g["strain"].astype(float).fillna(0).abs()
        if mode == 3:
            e = pd.Series([e[j : j + n].mean() for j in range(len(e) - n + 1)], dtype=float)
        hot = e > 20.0
        keep = [(a, b) for a, b in loop_runs(hot) if mode == 1 or b - a + 1 >= least]
        want += [(name, i) for a, b in keep for i in range(a, b + 1)]
    assert sorted(map(tuple, got.to_numpy().tolist())) == want


def test_rolling_and_sequences(data):
    pdf, df = data
    got = rolling.rolling_features(df, 6, size=SIZE).toPandas().sort_values(["sensor", "rn"])
    strain = pdf["strain"].astype(float).groupby(pdf["sensor"])
    for c, f in (("rolling_mean", "mean"), ("rolling_var", "var"), ("rolling_std", "std")):
        want = strain.transform(lambda s: getattr(s.rolling(6), f)())
        np.testing.assert_allclose(got[c].astype(float), want, rtol=1e-6, atol=1e-4)
    seq = anomaly.sequences(df, 9, ["strain"], size=SIZE).toPandas()
    lengths = pdf.groupby("sensor").size()
    assert len(seq) == sum(max(n - 9, 0) for n in lengths)
    whole = anomaly.sequences(df, 9, ["strain"], drop_last=False, label="end", size=SIZE).toPandas()
    assert len(whole) == sum(max(n - 8, 0) for n in lengths)
    row = whole.iloc[0]
    g = pdf[(pdf["sensor"] == row["sensor"])].set_index("rn")
    assert row["time"] == g["time"][row["rn"] + 8]
    assert [s["strain"] for s in row["sequence"]] == [
        None if v != v or v is None else v for v in g["strain"].loc[row["rn"] : row["rn"] + 8]
    ]


def test_numbering_by_slots_and_by_sort(spark, data):
    pdf, df = data
    shuffled = df.drop("rn").withColumn("id", F.xxhash64("sensor", "time"))
    for rows_per_bucket in (7, 100_000):
        got = scan.number_by_time(shuffled, ties=["id"], rows_per_bucket=rows_per_bucket).toPandas()
        same(got, pdf)
    same(scan.number_by_sort(shuffled, ["sensor"], ["time", "id"], rows_per_part=50).toPandas(), pdf)
    burst = shuffled.withColumn("time", F.lit("2020-01-01").cast("timestamp"))
    got = scan.number_by_time(burst, ties=["id"], rows_per_bucket=50).toPandas()
    for _, g in got.groupby("sensor"):
        assert sorted(g["rn"]) == list(range(len(g)))
        assert g.sort_values("rn")["id"].is_monotonic_increasing


def test_quantiles_in_brackets(spark, data):
    pdf, df = data
    ps = [0.0, 0.25, 0.5, 0.9, 1.0]
    for accuracy in (20, 1000):
        got = bracketed_quantiles(df, ["sensor"], "strain", ps, accuracy=accuracy).toPandas().set_index("sensor")["q"]
        for name, g in per_sensor(pdf):
            v = g["strain"].dropna().astype(float)
            if len(v):
                np.testing.assert_allclose(got[name], np.quantile(v, ps), atol=1e-9)
    one = bracketed_quantiles(df, [], "strain", ps, accuracy=50).first()["q"]
    np.testing.assert_allclose(one, np.quantile(pdf["strain"].dropna().astype(float), ps), atol=1e-9)
    large = exact_quantiles(df, ["sensor"], "strain", ps, buffer_rows=10)
    small = exact_quantiles(df, ["sensor"], "strain", ps)
    a, b = large.toPandas().set_index("sensor")["q"], small.toPandas().set_index("sensor")["q"]
    for name in a.index:
        np.testing.assert_allclose(a[name], b[name], atol=1e-9)


def test_attach_beyond_the_broadcast_limit(data):
    pdf, df = data
    side = df.groupBy("sensor").agg(F.max("rn").alias("last"))
    got = attach(df, side, ["sensor"], limit=3).toPandas()
    assert len(got) == len(pdf)
    assert (got["last"] == got.groupby("sensor")["rn"].transform("max")).all()


def test_correlation(data):
    pdf, df = data
    got = explore.pairwise_correlation(df).toPandas()
    blocked = explore.pairwise_correlation(df, block=2, cells=50).toPandas()
    keys = ["sensor_a", "sensor_b"]
    pd.testing.assert_frame_equal(got.sort_values(keys, ignore_index=True), blocked.sort_values(keys, ignore_index=True))
    wide = pdf.pivot(index="time", columns="sensor", values="strain").astype(float)
    for r in got.itertuples():
        both = wide[[r.sensor_a, r.sensor_b]].dropna() if r.sensor_a != r.sensor_b else wide[[r.sensor_a]].dropna()
        assert r.n == len(both)
        if len(both) > 2 and r.corr is not None and not math.isnan(r.corr) and r.sensor_a != r.sensor_b:
            want = np.corrcoef(both.to_numpy().T)[0, 1]
            assert abs(r.corr - want) < 1e-6 or math.isnan(want)


def test_kalman(data):
    pdf, df = data
    got = rolling.kalman_filter(df, 1.1, 0.9, 0.01, 4.0, 0.5, 1.0, size=SIZE).toPandas()
    for name, g in per_sensor(pdf):
        x, p, want = 0.5, 1.0, []
        for z in g["strain"].dropna().astype(float):
            x, p = 1.1 * x, 1.1 * p * 1.1 + 0.01
            k = p * 0.9 / (0.9 * p * 0.9 + 4.0)
            x, p = x + k * (z - 0.9 * x), (1 - k * 0.9) * p
            want.append(x)
        mine = got[got["sensor"] == name].sort_values("rn")["state"].map(lambda s: s[0])
        np.testing.assert_allclose(mine, want, rtol=1e-7)


def test_kalman_vector(data):
    pdf, df = data
    a, h = np.array([[1.0, 1.0], [0.0, 1.0]]), np.array([[1.0, 0.0]])
    q, r, p0, x0 = np.eye(2) * 0.01, np.array([[2.0]]), np.eye(2), np.array([1.0, 0.0])
    got = rolling.kalman_filter(df, a, h, q, r, x0, p0, keep_first=True, size=SIZE).toPandas()
    for name, g in per_sensor(pdf):
        x, p, want = x0, p0, []
        for t, z in enumerate(g["strain"].dropna().astype(float)):
            if t:
                x, p = a @ x, a @ p @ a.T + q
                k = p @ h.T @ np.linalg.inv(h @ p @ h.T + r)
                x, p = x + k @ (np.array([z]) - h @ x), p - k @ h @ p
            want.append(x)
        mine = got[got["sensor"] == name].sort_values("rn")["state"]
        if want:
            np.testing.assert_allclose(np.stack(mine), np.stack(want), rtol=1e-6, atol=1e-6)


def test_shifts_and_merge(spark, data):
    pdf, df = data
    spans = pd.DataFrame(
        [(n, 5, 60, 3) for n, g in per_sensor(pdf) if len(g) > 70], columns=["sensor", "start_rn", "end_rn", "ref_rn"]
    )
    table = spark.createDataFrame(spans)
    moved = regions.apply_shifts(df, table, size=SIZE)
    got = regions.merge_segment(df, moved, table, size=SIZE).toPandas()
    parts = []
    for n, g in per_sensor(pdf):
        g["strain"] = g["strain"].astype(float)
        if len(g) > 70:
            g.loc[5:60, "strain"] += g["strain"][3] - g["strain"][5]
        parts.append(g)
    want = pd.concat(parts).sort_values(["sensor", "rn"], ignore_index=True)
    got = got.sort_values(["sensor", "rn"], ignore_index=True)
    defined = want["strain"].notna()
    np.testing.assert_allclose(got["strain"].astype(float)[defined], want["strain"][defined], atol=1e-9)
