"""Writing intermediate tables, and joins that broadcast only what was measured."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from sensorframe.session import shared_folder

BROADCAST_ROWS = 200_000


def new_path(spark: SparkSession) -> str:
    """A fresh place for a table in the shared folder."""
    return f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"


def store(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Cuts the lineage, survives the loss of executors and fixes the outcome of
    anything that depends on sampling or task order.
    """
    path = new_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Sized:
    """A stored table and its number of rows."""

    def __init__(self, df: DataFrame) -> None:
        self.table = store(df)
        self.rows = self.table.count()

    def renamed(self, names: dict[str, str]) -> Sized:
        """The same stored table under other column names."""
        out = object.__new__(Sized)
        out.table, out.rows = self.table.withColumnsRenamed(names), self.rows
        return out


def join_same(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join on ``keys`` in which NULL equals NULL; the keys of ``left`` stay."""
    renamed = right.withColumnsRenamed({k: f"_same_{i}" for i, k in enumerate(keys)})
    on = F.lit(True)
    for i, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"_same_{i}"))
    return left.join(renamed, on, how).drop(*[f"_same_{i}" for i in range(len(keys))])


def attach(
    df: DataFrame,
    side: DataFrame | Sized,
    keys: Sequence[str],
    how: str = "left",
    limit: int = BROADCAST_ROWS,
) -> DataFrame:
    """Join a per-key table to ``df``; a NULL key meets a NULL key.

    ``side`` (one row per key) is computed once and stored, then counted: up to
    ``limit`` rows it is broadcast, so a key that holds most of ``df`` costs no
    shuffle.  A larger one means many keys; both sides are then joined on the key
    plus a salt, so that a hot key still spreads over several tasks.  A :class:`Sized`
    side is not computed again.
    """
    side = side if isinstance(side, Sized) else Sized(side)
    side, rows = side.table, side.rows
    if rows <= limit:
        return join_same(df, F.broadcast(side), keys, how)
    salts = 16
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(*df.columns), F.lit(salts)).cast("int"))
    spread = side.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return join_same(salted, spread, [*keys, "_salt"], how).drop("_salt")


def one_row(df: DataFrame, *cols: Column) -> Column:
    """The single row of an ungrouped aggregate as a struct-valued scalar subquery."""
    return df.agg(F.struct(*cols).alias("row")).scalar()
