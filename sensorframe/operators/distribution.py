"""Strain profiles along a beam: matrices, row outliers, principal directions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from sensorframe.functions.columns import array_mean, array_std
from sensorframe.functions.quantiles import exact_quantiles
from sensorframe.operators.filters import drop_incomplete
from sensorframe.plans.sizing import one_row

KEY = "vec_id"


def distribution_matrix(raw: DataFrame, loop: str, coord: str = "beam_coord") -> DataFrame:
    """One row per snapshot of ``loop`` with its (coord, strain) cells in coordinate order.

    The first line wins where a coordinate is repeated.
    """
    cells = raw.filter(F.col("loop") == loop).groupBy("ts", F.col(coord).alias("coord")).agg(
        F.min_by("strain", "line").alias("strain")
    )
    return cells.groupBy("ts").agg(F.sort_array(F.collect_list(F.struct("coord", "strain"))).alias("cells"))


def row_stats(df: DataFrame, profile: str = "profile") -> DataFrame:
    """Mean, sample deviation and maximum of the absolute values of each profile."""
    size = F.transform(profile, lambda x: F.abs(x))
    return df.withColumn("_abs", size).select(
        *df.columns,
        array_mean(F.col("_abs")).alias("abs_mean"),
        array_std(F.col("_abs")).alias("abs_std"),
        F.array_max("_abs").alias("abs_max"),
    )


def _flag_columns(stats: DataFrame, by_mean: Column, threshold: float, individual: float | None) -> DataFrame:
    flags = {
        "by_mean": by_mean,
        "by_row": F.col("abs_max") > F.col("abs_mean") + threshold * F.col("abs_std"),
    }
    if individual is not None:
        flags["by_value"] = F.col("abs_max") > individual * F.col("abs_mean")
    return stats.withColumns({k: F.coalesce(v, F.lit(False)) for k, v in flags.items()})


def outlier_flags(df: DataFrame, threshold: float = 7, individual: float = 7) -> DataFrame:
    """Flag complete profiles: mean outside the IQR fence of all means, a value far above
    its own row, a maximum far above the row mean (all on absolute values)."""
    stats = row_stats(drop_incomplete(df))
    q = exact_quantiles(stats, [], "abs_mean", [0.25, 0.75]).scalar()
    q1, q3 = q[0], q[1]
    mean = F.col("abs_mean")
    by_mean = (mean < q1 - threshold * (q3 - q1)) | (mean > q3 + threshold * (q3 - q1))
    return _flag_columns(stats, by_mean, threshold, individual)


def row_outliers(df: DataFrame, threshold: float = 7, individual: float = 7) -> DataFrame:
    """Profiles that are complete and carry none of the three outlier flags."""
    flags = outlier_flags(df, threshold, individual)
    return flags.filter(~(F.col("by_mean") | F.col("by_row") | F.col("by_value"))).select(*df.columns)


def row_outliers_zscore(df: DataFrame, threshold: float = 1) -> DataFrame:
    """Older rule: row mean further than ``threshold`` deviations from the mean of means,
    or a value far above its own row."""
    stats = row_stats(df)
    whole = one_row(stats, F.avg("abs_mean").alias("m"), F.stddev_samp("abs_mean").alias("s"))
    by_mean = F.abs(F.col("abs_mean") - whole["m"]) > threshold * whole["s"]
    flags = _flag_columns(stats, by_mean, threshold, None)
    return flags.filter(~(F.col("by_mean") | F.col("by_row"))).select(*df.columns)


def outlier_union(df: DataFrame, threshold: float = 7, individual: float = 7, key: str = KEY) -> DataFrame:
    """Keys of rows flagged by at least one of the three rules."""
    flags = outlier_flags(df, threshold, individual)
    return flags.filter(F.col("by_mean") | F.col("by_row") | F.col("by_value")).select(key).distinct()


def principal(rows: DataFrame, column: str) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    """Count, mean, variances and directions (columns, largest variance first) of an array column.

    Tasks sum values and products around the first row's values, so that large offsets do not cancel digits;
    one vector per task is added up, and only d * d numbers reach the driver, whatever the number of rows.
    """
    first = rows.select(column).filter(F.col(column).isNotNull()).first()
    if first is None:
        raise ValueError("principal directions need a row")
    origin = np.array(first[0], float)
    d = len(origin)

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(1 + d + d * d)
        for pdf in batches:
            if len(pdf):
                x = np.stack(pdf["x"].to_numpy()).astype(float) - origin
                total += np.concatenate(([len(x)], x.sum(axis=0), (x.T @ x).ravel()))
        yield pd.DataFrame({"part": [0], "s": [total]})

    parts = rows.select(F.col(column).cast("array<double>").alias("x")).filter("x IS NOT NULL").mapInPandas(add, "part int, s array<double>")
    cells = parts.select(F.posexplode("s").alias("i", "v")).groupBy("i").agg(F.sum("v").alias("v"))
    total = np.zeros(1 + d + d * d)
    for row in cells.collect():
        total[row["i"]] = row["v"]
    n, mean = int(total[0]), total[1 : 1 + d] / total[0]
    covariance = total[1 + d :].reshape(d, d) / total[0] - np.outer(mean, mean)
    variances, directions = np.linalg.eigh((covariance + covariance.T) / 2)
    return n, mean + origin, np.maximum(variances[::-1], 0.0), directions[:, ::-1]


def explained_variance(df: DataFrame, k: int = 10, profile: str = "profile") -> DataFrame:
    """Share of variance per principal direction in percent (1 decimal), and its running total."""
    _, _, variances, _ = principal(df, profile)
    percent = np.round(variances[:k] / max(variances.sum(), 1e-300) * 100, 1)
    rows = [(i + 1, float(p), float(c)) for i, (p, c) in enumerate(zip(percent, percent.cumsum()))]
    return df.sparkSession.createDataFrame(rows, "component int, percent double, cumulative double")


def pca_scores(df: DataFrame, k: int = 8, profile: str = "profile", out: str = "scores") -> DataFrame:
    """Principal direction scores, each scaled to zero mean and unit population deviation.

    The largest loading of every direction is made positive.  The result column is an array.
    """
    _, mean, variances, directions = principal(df, profile)
    loadings = directions[:, :k]
    signs = np.sign(loadings[np.abs(loadings).argmax(axis=0), np.arange(loadings.shape[1])])
    deviation = np.sqrt(variances[:k])
    matrix = loadings * (signs / np.where(deviation > 0, deviation, 1.0))

    @F.pandas_udf("array<double>")
    def score(profiles: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else (np.asarray(x, float) - mean) @ matrix for x in profiles], dtype=object)

    return df.withColumn(out, score(F.col(profile).cast("array<double>")))


def cluster_profiles(
    df: DataFrame, keep: list | None = None, profile: str = "profile", label: str = "cluster", step: float = 2.5
) -> DataFrame:
    """Mean, sample deviation and band per (cluster, coordinate), with the cluster's average deviation."""
    if keep is not None:
        df = df.filter(F.col(label).isin(keep))
    cells = df.select(label, F.posexplode(profile).alias("_i", "_x"))
    per_coord = cells.groupBy(label, "_i").agg(F.avg("_x").alias("mean"), F.stddev_samp("_x").alias("std"))
    average = per_coord.groupBy(label).agg(F.avg("std").alias("avg_std"))
    return per_coord.join(average, label).select(
        label,
        (F.col("_i") * F.lit(step)).alias("coord"),
        "mean",
        "std",
        (F.col("mean") - F.col("std")).alias("lower"),
        (F.col("mean") + F.col("std")).alias("upper"),
        "avg_std",
    )
