"""Run registered queries in Spark and their SQL in DuckDB and compare whole results."""

from __future__ import annotations

import glob
import os
import sys
import time

import duckdb
import pandas as pd

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def connect(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for path in glob.glob(f"{sf}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def canonical(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if str(df[c].dtype).startswith("datetime"):
            df[c] = df[c].astype("datetime64[us]")
        df[c] = df[c].map(lambda v: "NULL" if v is None or v is pd.NaT or v != v else str(v))
    return df.sort_values(list(df.columns), ignore_index=True) if len(df.columns) else df


def difference(got: pd.DataFrame, want: pd.DataFrame) -> str | None:
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} != {sorted(want.columns)}"
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}"
    kinds = {c: (got[c].dtype.kind, want[c].dtype.kind) for c in got.columns if got[c].dtype.kind != want[c].dtype.kind}
    a, b = canonical(got), canonical(want)
    for c in a.columns:
        bad = a[c] != b[c]
        if bad.any():
            i = bad.idxmax()
            return f"{int(bad.sum())} values of {c} differ, first {a.loc[i].to_dict()} != {b.loc[i].to_dict()} kinds {kinds}"
    return f"dtype kinds {kinds}" if kinds else None


def main(names: list[str], sf: str) -> int:
    from sensorframe.queries import ORACLES, QUERIES
    from sensorframe.session import build_session

    spark = build_session(
        master="local[8]",
        spark__sql__shuffle__partitions="8",
        spark__ui__enabled="false",
        spark__driver__memory="12g",
        spark__ui__showConsoleProgress="false",
    )
    spark.sparkContext.setLogLevel("OFF")
    con = connect(sf)
    bad = 0
    for name in names or list(QUERIES):
        begun = time.time()
        try:
            got = QUERIES[name](spark, sf).toPandas()
            spent = time.time() - begun
            if name not in ORACLES:
                print(f"rows  {name}: {len(got)} rows, {spent:.2f}s", flush=True)
                continue
            problem = difference(got, con.execute(ORACLES[name]).df())
        except Exception as e:  # report and go on with the next query
            problem, spent, got = f"{type(e).__name__}: {str(e)[:1500]}", time.time() - begun, []
        bad += problem is not None
        print(f"{'FAIL' if problem else 'ok  '}  {name}: {len(got)} rows, {spent:.2f}s {problem or ''}", flush=True)
    return bad


if __name__ == "__main__":
    sf_dir = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    sys.exit(1 if main(sys.argv[1:], sf_dir) else 0)
