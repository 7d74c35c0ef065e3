"""Summaries of series and of the files they came from."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from sensorframe.functions.quantiles import exact_quantiles
from sensorframe.plans.scan import number_by_sort
from sensorframe.plans.sizing import Sized, attach, join_same, store

STEP = "4 hours"


def file_counts(listing: DataFrame) -> DataFrame:
    return listing.groupBy("file_name").agg(F.count(F.lit(1)).alias("n"))


def sufficient_loops(listing: DataFrame, min_count: int = 2500) -> DataFrame:
    """Loops listed more than ``min_count`` times."""
    return file_counts(listing).filter(F.col("n") > min_count)


def describe_series(df: DataFrame, col: str = "strain") -> DataFrame:
    """Count, mean, sample deviation, extremes and quartiles per sensor."""
    basic = df.groupBy("sensor").agg(
        F.count(col).alias("n"),
        F.avg(col).alias("mean"),
        F.stddev_samp(col).alias("std"),
        F.min(col).alias("min"),
        F.max(col).alias("max"),
    )
    quartiles = exact_quantiles(df, ["sensor"], col, [0.25, 0.5, 0.75])
    return basic.join(quartiles, "sensor", "left").select(
        "sensor",
        "n",
        "mean",
        "std",
        "min",
        F.col("q")[0].alias("q25"),
        F.col("q")[1].alias("q50"),
        F.col("q")[2].alias("q75"),
        "max",
    )


def histogram(df: DataFrame, col: str = "strain", bins: int = 30) -> DataFrame:
    """Counts in ``bins`` equal-width bins per sensor; the last bin includes the maximum."""
    present = df.filter(F.col(col).isNotNull())
    extent = present.groupBy("sensor").agg(F.min(col).alias("_a"), F.max(col).alias("_b")).select(
        "sensor",
        F.when(F.col("_a") == F.col("_b"), F.col("_a") - 0.5).otherwise(F.col("_a")).alias("_lo"),
        F.when(F.col("_a") == F.col("_b"), F.col("_b") + 0.5).otherwise(F.col("_b")).alias("_hi"),
    )
    width = (F.col("_hi") - F.col("_lo")) / bins
    slot = F.least(F.floor((F.col(col) - F.col("_lo")) / width), F.lit(bins - 1)).cast("int")
    counts = attach(present, extent, ["sensor"]).groupBy("sensor", slot.alias("bin")).agg(
        F.count(F.lit(1)).alias("n")
    )
    every = extent.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    return every.join(counts, ["sensor", "bin"], "left").select(
        "sensor",
        "bin",
        (F.col("_lo") + F.col("bin") * width).alias("lo"),
        (F.col("_lo") + (F.col("bin") + 1) * width).alias("hi"),
        F.coalesce("n", F.lit(0)).alias("n"),
    )


def boxplot_stats(df: DataFrame, col: str = "strain", reach: float = 1.5) -> DataFrame:
    """Quartiles, whisker ends (last points within ``reach`` IQR) and number of outliers."""
    quartiles = exact_quantiles(df, ["sensor"], col, [0.25, 0.5, 0.75])
    rows = attach(df.filter(F.col(col).isNotNull()), quartiles, ["sensor"])
    q1, q3 = F.col("q")[0], F.col("q")[2]
    low, high = q1 - reach * (q3 - q1), q3 + reach * (q3 - q1)
    inside = F.col(col).between(low, high)
    return (
        rows.groupBy("sensor")
        .agg(
            F.first("q").alias("q"),
            F.min(F.when(inside, F.col(col))).alias("whisker_lo"),
            F.max(F.when(inside, F.col(col))).alias("whisker_hi"),
            F.count(F.when(~inside, 1)).alias("outliers"),
        )
        .select(
            "sensor",
            F.col("q")[0].alias("q25"),
            F.col("q")[1].alias("q50"),
            F.col("q")[2].alias("q75"),
            "whisker_lo",
            "whisker_hi",
            "outliers",
        )
    )


#: sensors of a block, cells of a part of the moments, moments of one product
BLOCK, CELLS, SLICE = 256, 2_000_000, 4_096
_SUMS = ("n", "sa", "sb", "saa", "sbb", "sab")


def _products(block: int) -> Callable[[pa.Table], pa.Table]:
    """Sums over the moments that two blocks of sensors share, for every pair of sensors with a shared moment."""

    def side(table: pa.Table, of: int) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        row = table.column("own").to_pylist().index(of)
        t, i, v = (table.column(c).combine_chunks()[row].values for c in ("t", "i", "v"))
        return t, i.to_numpy(zero_copy_only=False) - of * block, v.to_numpy(zero_copy_only=False)

    def dense(rows: np.ndarray, of: np.ndarray, values: np.ndarray, low: int, n: int, wide: int) -> tuple[np.ndarray, np.ndarray]:
        at = slice(*np.searchsorted(rows, [low, low + n]))
        x, m = np.zeros((n, wide)), np.zeros((n, wide))
        x[rows[at] - low, of[at]], m[rows[at] - low, of[at]] = values[at], 1.0
        return x, m

    def run(table: pa.Table) -> pa.Table:
        a, b = table["a"][0].as_py(), table["b"][0].as_py()
        (ta, ia, va), (tb, ib, vb) = side(table, a), side(table, b)
        codes = pa.concat_arrays([ta, tb]).dictionary_encode().indices.to_numpy()
        ca, cb = codes[: len(ta)], codes[len(ta) :]
        shared = np.intersect1d(ca, cb) if a != b else np.flatnonzero(np.bincount(ca) > 0)
        sides = []
        for c, i, v in ((ca, ia, va), (cb, ib, vb)):
            keep = np.flatnonzero(np.isin(c, shared))
            order = keep[np.argsort(c[keep], kind="stable")]
            sides.append((np.searchsorted(shared, c[order]), i[order], v[order]))
        wide, high = (int(i.max()) + 1 for i in (ia, ib))
        total = np.zeros((6, wide, high))
        for low in range(0, len(shared), SLICE):
            n = min(SLICE, len(shared) - low)
            (x, m), (y, o) = dense(*sides[0], low, n, wide), dense(*sides[1], low, n, high)
            total += np.stack([m.T @ o, x.T @ o, m.T @ y, (x * x).T @ o, m.T @ (y * y), x.T @ y])
        i, j = np.nonzero(np.triu(total[0]) if a == b else total[0])
        out = [pa.array(i + a * block, pa.int64()), pa.array(j + b * block, pa.int64()), *[pa.array(s[i, j]) for s in total]]
        return pa.table(out, names=["i", "j", *_SUMS])

    return run


def pairwise_correlation(
    df: DataFrame, by: str = "time", col: str = "strain", block: int = BLOCK, cells: int = CELLS
) -> DataFrame:
    """Pearson correlation of every pair of sensors over the moments where both are present.

    Sensors are numbered and cut into blocks, moments are dealt into parts.  The cells of a block and part are packed into one
    row, which is copied once per block of the result; two such rows give one product matrix of ``block`` x ``block`` sums, so no
    task holds more than that, whatever the number of sensors, and what leaves a task is one row per pair and not one per
    pair and moment.  Values are taken relative to the sensor's mean, which keeps the sums small.
    """
    present = df.filter(F.col(col).isNotNull() & F.col(by).isNotNull())
    means = present.groupBy("sensor").agg(F.avg(col).alias("_m"), F.count(F.lit(1)).alias("_n"))
    means = Sized(number_by_sort(means, [], ["sensor"], "_i"))
    blocks = -(-means.rows // block)
    parts = max(1, -(-int(means.table.agg(F.sum("_n")).first()[0] or 0) // cells))
    kind = dict(df.dtypes)[by]

    def pack(table: pa.Table) -> pa.Table:
        lists = [pa.ListArray.from_arrays(pa.array([0, len(table)], pa.int32()), table[c].combine_chunks()) for c in ("t", "i", "v")]
        return pa.table([table["part"][:1], table["own"][:1], *lists], names=["part", "own", "t", "i", "v"])

    centred = attach(present, means, ["sensor"], "inner").select(
        F.pmod(F.xxhash64(by), F.lit(parts)).cast("int").alias("part"),
        F.call_function("div", F.col("_i"), F.lit(block)).alias("own"),
        F.col(by).alias("t"),
        F.col("_i").alias("i"),
        (F.col(col) - F.col("_m")).cast("double").alias("v"),
    )
    schema = f"part int, own long, t array<{kind}>, i array<long>, v array<double>"
    packed = centred.groupBy("part", "own").applyInArrow(pack, schema)
    if blocks > 1:
        packed = store(packed)
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(max(blocks - 1, 0)).cast("long")))
    met = packed.withColumn("_q", other).select(
        "*", F.least("own", "_q").alias("a"), F.greatest("own", "_q").alias("b")
    ).drop("_q")
    both = F.count(F.lit(1)).over(Window.partitionBy("part", "a", "b"))  # at most two rows
    met = met.withColumn("_both", both).filter((F.col("_both") == 2) | (F.col("a") == F.col("b"))).drop("_both")
    sums = met.groupBy("part", "a", "b").applyInArrow(_products(block), "i long, j long, " + ", ".join(f"{c} double" for c in _SUMS))
    s = sums.groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in _SUMS])
    n = F.col("n")
    spread_a = n * F.col("saa") - F.col("sa") * F.col("sa")
    spread_b = n * F.col("sbb") - F.col("sb") * F.col("sb")
    shared = n * F.col("sab") - F.col("sa") * F.col("sb")
    corr = F.when((spread_a > 0) & (spread_b > 0), shared / (F.sqrt(spread_a) * F.sqrt(spread_b)))
    s = s.select("i", "j", n.cast("long").alias("n"), corr.alias("corr"))
    for index, name in (("i", "sensor_a"), ("j", "sensor_b")):
        s = attach(s, means.renamed({"_i": index, "sensor": name}), [index], "inner").drop("_m", "_n")
    return s.select("sensor_a", "sensor_b", "n", "corr")


def availability_matrix(listing: DataFrame, start, stop, step: str = STEP) -> DataFrame:
    """Loop x grid time, 1 where the file exists.  ``start``/``stop`` may be scalar columns."""
    grid = F.sequence(F.lit(start), F.lit(stop), F.expr(f"interval {step}"))
    every = listing.select("file_name").distinct().withColumn("ts", F.explode(grid))
    there = listing.select("file_name", "ts").distinct().withColumn("available", F.lit(1))
    return every.join(there, ["file_name", "ts"], "left").fillna(0, ["available"])


def activity_counts(listing: DataFrame, col: str = "file_name") -> DataFrame:
    """Loop x time number of files, 0 where a loop has none at a listed time."""
    there = listing.groupBy("ts", col).agg(F.count(F.lit(1)).alias("n"))
    every = listing.select("ts").distinct().crossJoin(listing.select(col).distinct())  # the cells of the result
    return join_same(every, there, ["ts", col], "left").fillna(0, ["n"])


def cluster_sizes(df: DataFrame, label: str = "cluster") -> DataFrame:
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))


def span_midpoints(raw: DataFrame) -> DataFrame:
    """Rows per span and the 1-based row in its middle."""
    return raw.groupBy("span").agg(F.count(F.lit(1)).alias("n")).withColumn(
        "midpoint", F.ceil(F.col("n") / F.lit(2))
    )


def alarm_matrix(texts: DataFrame, alarm: str, loops: Sequence[str]) -> DataFrame:
    """1 per time and loop whose text holds ``"<alarm>;<loop>"``."""
    hits = F.array(
        *[
            F.struct(F.lit(x).alias("loop"), F.col("text").contains(f"{alarm};{x}").cast("int").alias("flag"))
            for x in loops
        ]
    )
    return texts.select("ts", F.inline(hits)).groupBy("ts", "loop").agg(F.max("flag").alias("flag"))


def missing_count(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Number of missing cells over all ``cols``."""
    per_row = sum((F.col(c).isNull().cast("long") for c in cols), F.lit(0).cast("long"))
    return df.agg(F.coalesce(F.sum(per_row), F.lit(0)).alias("missing"))


def cluster_timeline(df: DataFrame, time: str = "ts", label: str = "cluster") -> DataFrame:
    """Rows per (time, cluster) for clusters in use, in time order."""
    return (
        df.filter(F.col(label).isNotNull())
        .groupBy(time, label)
        .agg(F.count(F.lit(1)).alias("n"))
        .orderBy(time, label)
    )


def label_agreement(df: DataFrame, a: str, b: str, c: str) -> DataFrame:
    """Rows per agreement class of three labelings."""
    x, y, z = F.col(a), F.col(b), F.col(c)
    kind = (
        F.when((x == y) & (x == z), "all")
        .when(x == y, f"{a}={b}")
        .when(x == z, f"{a}={c}")
        .when(y == z, f"{b}={c}")
        .otherwise("none")
    )
    return df.groupBy(kind.alias("agreement")).agg(F.count(F.lit(1)).alias("n"))
