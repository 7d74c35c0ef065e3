"""Main directions of tables with very many columns.

A table is kept as cells ``(rn, column, x)``; absent cells are zero.  Cells are packed into blocks of whole rows.  Directions
come from a block Krylov iteration: the covariance is never formed; every pass over the blocks multiplies it with a few vectors
(columns x vectors numbers, the size of the result), and the best directions within all vectors so far are found on the
driver.  It stops when what the directions leave over is below a tolerance, so the result is that of a full
decomposition; if the vectors span all columns it is reached in one pass.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from sensorframe.plans.scan import chunk_of
from sensorframe.plans.sizing import store

#: cells of a block (rows x columns), numbers in a part of a summed vector
CELLS, PART = 1 << 20, 1 << 14
#: vectors beyond the wanted ones, and blocks of vectors before the iteration starts again from the best
SPARE, BLOCKS = 16, 5


@dataclass
class Directions:
    """Mean, directions (columns x k, largest variance first), variances, total variance, and the relative residual reached."""

    mean: np.ndarray
    basis: np.ndarray
    variances: np.ndarray
    total: float
    residual: float
    passes: int


def pack(cells: DataFrame, columns: int) -> DataFrame:
    """Blocks of whole rows: ``(first, rows, cols, vals)`` with the row's place in the block and the column of every value.

    ``cells`` has ``rn, column, x``; a (row, column) is there once.
    """
    size = max(1, CELLS // max(columns, 1))

    def run(table: pa.Table) -> pa.Table:
        rn = table["rn"].to_numpy()
        first = int(rn[0]) // size * size
        out = {"rows": rn - first, "cols": table["column"].to_numpy(), "vals": table["x"].to_numpy()}
        kinds = {"rows": pa.int32(), "cols": pa.int32(), "vals": pa.float64()}
        lists = [pa.array([v], pa.list_(kinds[c])) for c, v in out.items()]
        return pa.table([pa.array([first]), *lists], names=["first", *out])

    narrow = cells.select(F.col("rn").cast("long"), F.col("column").cast("int"), F.col("x").cast("double"))
    schema = "first long, rows array<int>, cols array<int>, vals array<double>"
    return store(narrow.groupBy(chunk_of("rn", size)).applyInArrow(run, schema))


def unpacked(batch: pa.RecordBatch, columns: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """``(first row, places, columns, matrix of the block's rows)``; rows without a cell are not in the matrix."""
    for i in range(len(batch)):
        rows, cols, vals = (batch.column(c)[i].values.to_numpy(zero_copy_only=False) for c in ("rows", "cols", "vals"))
        present, at = np.unique(rows, return_inverse=True)
        matrix = np.zeros((len(present), columns))
        matrix[at, cols] = vals
        yield batch.column("first")[i].as_py(), rows, cols, matrix


def _summed(blocks: DataFrame, columns: int, per_block: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """Sum of ``per_block(matrix)`` over all blocks; tasks add up first, then parts of the vector are added in parallel."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: np.ndarray | None = None
        for batch in batches:
            for _, _, _, matrix in unpacked(batch, columns):
                one = per_block(matrix)
                total = one if total is None else total + one
        if total is not None:
            parts = [total[a : a + PART] for a in range(0, len(total), PART)]
            yield pa.RecordBatch.from_arrays([pa.array(range(len(parts))), pa.array(parts, pa.list_(pa.float64()))], ["part", "v"])

    def whole(table: pa.Table) -> pa.Table:
        total: np.ndarray | float = 0.0
        for chunk in table["v"].chunks:
            for v in chunk:
                total = total + v.values.to_numpy(zero_copy_only=False)
        return pa.table({"part": table["part"][:1], "v": pa.array([total], pa.list_(pa.float64()))})

    parts = blocks.mapInArrow(add, "part long, v array<double>").groupBy("part").applyInArrow(whole, "part long, v array<double>")
    rows = parts.toArrow().sort_by("part")
    return np.concatenate([v.values.to_numpy() for chunk in rows["v"].chunks for v in chunk]) if len(rows) else np.empty(0)


def _orthonormal(new: np.ndarray, to: np.ndarray | None = None) -> np.ndarray:
    """Orthonormal vectors of the span of ``new`` without that of ``to``."""
    for _ in range(2):
        if to is not None and to.shape[1]:
            new = new - to @ (to.T @ new)
        size = np.linalg.norm(new, axis=0)
        new = new[:, size > 0] / size[size > 0]
        q, r = np.linalg.qr(new)
        new = q[:, np.abs(np.diag(r)) > 1e-10]
    return new


def directions(blocks: DataFrame, columns: int, rows: int, k: int, tolerance: float = 1e-9, passes: int = 100, seed: int = 7) -> Directions:
    """The ``k`` main directions of ``rows`` rows in ``blocks``, each with its largest loading positive."""
    moments = _summed(blocks, columns, lambda m: np.concatenate((m.sum(axis=0), (m * m).sum(axis=0))))
    if not len(moments) or not rows:
        raise ValueError("main directions need a row")
    mean = moments[:columns] / rows
    total = float(np.maximum(moments[columns:] / rows - mean * mean, 0.0).sum())
    k = min(k, columns)

    def covered(vectors: np.ndarray) -> np.ndarray:
        """Covariance times vectors; rows without any cell are the vector ``-mean`` once centred."""
        shift, wide = mean @ vectors, vectors.shape[1]

        def part(m: np.ndarray) -> np.ndarray:
            y = m @ vectors - shift
            return np.concatenate(((m.T @ y).ravel(), y.sum(axis=0), [len(m)]))

        sums = _summed(blocks, columns, part)
        z, y, n = sums[: columns * wide].reshape(columns, wide), sums[columns * wide : -1], sums[-1]
        return (z - np.outer(mean, y - (rows - n) * shift)) / rows

    wide = min(columns, k + SPARE)
    basis = _orthonormal(np.random.default_rng(seed).standard_normal((columns, wide)))
    images, done = covered(basis), 1
    while True:
        small = basis.T @ images
        values, turns = np.linalg.eigh((small + small.T) / 2)
        turns = turns[:, ::-1]
        values = values[::-1]
        found = basis @ turns[:, :k]
        left = images @ turns[:, :wide] - (basis @ turns[:, :wide]) * values[:wide]
        residual = float(np.linalg.norm(left[:, :k], axis=0).max() / max(values[0], 1e-300)) if values[0] > 0 else 0.0
        if residual <= tolerance or basis.shape[1] >= columns or done >= passes:
            break
        if basis.shape[1] + wide > BLOCKS * wide:
            keep = turns[:, : 2 * wide]
            basis, images = basis @ keep, images @ keep
        new = _orthonormal(left, basis)[:, : columns - basis.shape[1]]
        if not new.shape[1]:
            break
        basis, images, done = np.hstack((basis, new)), np.hstack((images, covered(new))), done + 1
    signs = np.sign(found[np.abs(found).argmax(axis=0), np.arange(k)])
    return Directions(mean, found * np.where(signs == 0, 1.0, signs), np.maximum(values[:k], 0.0), total, residual, done)


def restored(blocks: DataFrame, columns: int, known: Directions) -> DataFrame:
    """``(rn, column, actual, reconstructed)`` of every cell, restored from the directions."""
    mean, basis = known.mean, known.basis

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, rows, cols, m in unpacked(batch, columns):
                at = np.unique(rows, return_inverse=True)[1]
                again = (m - mean) @ basis @ basis.T + mean
                out = [pa.array(rows.astype(np.int64) + first), pa.array(cols), pa.array(m[at, cols]), pa.array(again[at, cols])]
                yield pa.RecordBatch.from_arrays(out, ["rn", "column", "actual", "reconstructed"])

    return blocks.mapInArrow(run, "rn long, column int, actual double, reconstructed double")
