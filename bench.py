"""Time the headline queries: one JSON line on stdout."""

from __future__ import annotations

import json
import os
import sys
import time

HEADLINE = [
    "preprocess",
    "clean_zeros_outliers",
    "interpolate_gaps",
    "gap_regions",
    "overlapping_regions",
    "rebaseline_regions",
    "rolling_features",
    "sequences",
    "minmax_scale",
    "anomaly_points_rolling",
    "anomaly_table",
    "extract_series",
    "describe_series",
    "pairwise_correlation",
    "availability_matrix",
    "beam_coordinates",
    "row_outliers",
    "cluster_profiles",
    "pca_scores",
    "davies_bouldin",
    "cluster_transitions",
    "kmeans_clusters",
    "stream_grid_means",
    "dpgmm_windows",
    "dpgmm_clusters",
    "gmm_clusters",
    "dbscan",
    "kalman_filter",
    "cluster_sweep",
    "reconstruction_error",
]


def main() -> None:
    from sensorframe.queries import QUERIES
    from sensorframe.session import build_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        spark__sql__shuffle__partitions=cpus,
        spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false",
        spark__driver__memory="16g",
    )
    spark.sparkContext.setLogLevel("OFF")
    names = sys.argv[1:] or HEADLINE

    def run(name: str) -> float:
        begun = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - begun

    run(names[0])  # start the JVM's compilers on something that is measured again below
    spent = {name: round(run(name), 3) for name in names}
    print(
        json.dumps(
            {
                "metric": "total seconds, headline queries",
                "value": round(sum(spent.values()), 3),
                "unit": "sec",
                "queries": spent,
                "sf": float(sf_dir.rstrip("/").rsplit("sf", 1)[-1]),
                "cpus": int(cpus),
            }
        )
    )


if __name__ == "__main__":
    main()
