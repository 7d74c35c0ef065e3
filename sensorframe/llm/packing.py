"""Packing token ids into rows of one length by best-fit decreasing.

Documents longer than a row are cut without loss: full rows first, then the rest.  Pieces of a block of documents
are placed longest first into the row with the least room that still holds them; a segment tree over the
possible amounts of room finds that row in logarithmic time.  A block is what one task holds at a time, so
packing needs no shuffle and no group is ever gathered.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

#: tokens packed together
BLOCK_TOKENS = 2_000_000

_SCHEMA = (
    "pack long, n_tokens int, ids binary, cu_seqlens array<int>, position_ids binary, "
    "doc_ids array<long>, doc_rows array<long>, doc_parts array<int>"
)
_ARROW = pa.schema(
    [
        ("pack", pa.int64()),
        ("n_tokens", pa.int32()),
        ("ids", pa.binary()),
        ("cu_seqlens", pa.list_(pa.int32())),
        ("position_ids", pa.binary()),
        ("doc_ids", pa.list_(pa.int64())),
        ("doc_rows", pa.list_(pa.int64())),
        ("doc_parts", pa.list_(pa.int32())),
    ]
)


class RoomTree:
    """Open rows by their free room; finds the least room of at least a size."""

    def __init__(self, most: int) -> None:
        self.leaves = 1 << max(1, (most + 1).bit_length())
        self.filled = [0] * (2 * self.leaves)  # open rows below each node
        self.rows: list[list[int]] = [[] for _ in range(most + 1)]

    def _change(self, room: int, by: int) -> None:
        node = room + self.leaves
        while node:
            self.filled[node] += by
            node >>= 1

    def put(self, row: int, room: int) -> None:
        if room:
            self.rows[room].append(row)
            self._change(room, 1)

    def take(self, size: int) -> tuple[int, int] | None:
        """Remove and return ``(row, room)`` with the least room that is at least ``size``."""
        node = size + self.leaves
        if not self.filled[node]:
            while node > 1 and (node & 1 or not self.filled[node + 1]):  # up until a right neighbour is filled
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.leaves:
                node *= 2
                if not self.filled[node]:
                    node += 1
        room = node - self.leaves
        self._change(room, -1)
        return self.rows[room].pop(), room


def best_fit(sizes: list[int], length: int) -> tuple[list[int], int]:
    """Row of every piece (each at most ``length``, longest first, ties in order), and the number of rows."""
    tree, place, rows = RoomTree(length), [0] * len(sizes), 0
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        found = tree.take(sizes[i]) if sizes[i] < length else None
        row, room = found or (rows, length)
        rows += found is None
        place[i] = row
        tree.put(row, room - sizes[i])
    return place, rows


def _block(docs: list[tuple[int | None, int, np.ndarray]], length: int, pad: int, kind: type, first: int) -> pa.RecordBatch:
    parts = [
        (name, row, part, ids[at : at + length])
        for name, row, ids in docs
        for part, at in enumerate(range(0, len(ids), length))
    ]
    place, rows = best_fit([len(p[3]) for p in parts], length)
    held: list[list[tuple]] = [[] for _ in range(rows)]
    for part, row in zip(parts, place):
        held[row].append(part)
    matrix = np.full((rows, length), pad, kind)
    position = np.zeros((rows, length), np.uint16 if length <= 1 << 16 else np.uint32)
    out = []
    for row, found in enumerate(held):
        ends = np.cumsum([0, *(len(p[3]) for p in found)])
        for p, a, b in zip(found, ends[:-1].tolist(), ends[1:].tolist()):
            matrix[row, a:b] = p[3]
            position[row, a:b] = np.arange(b - a)
        names, numbers, order = zip(*(p[:3] for p in found))
        out.append(
            (first + row, int(ends[-1]), matrix[row].tobytes(), ends.tolist(), position[row].tobytes(), names, numbers, order)
        )
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), _ARROW.types)], schema=_ARROW)


def pack(
    rows: DataFrame,
    length: int = 2048,
    id_col: str = "doc_id",
    ids_col: str = "ids",
    pad: int = 0,
    vocabulary: int = 1 << 16,
    block_tokens: int = BLOCK_TOKENS,
    encoder: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]] | None = None,
) -> DataFrame:
    """Pack the token ids of all rows into rows of ``length``.

    Every returned row is a line of the id matrix: ``ids`` (little-endian ``uint16``, or ``uint32`` from a vocabulary
    above 65,536, padded with ``pad``), ``n_tokens``, ``cu_seqlens`` (0, then the end of every segment), ``position_ids``
    (``uint16``, or ``uint32`` for rows above 65,536; 0 again at every segment) and for every segment ``doc_ids``, ``doc_rows`` (a number of the input row, which tells
    repeated or null ids apart) and ``doc_parts`` (which cut of the document).  Null and empty id lists take no room.
    With an ``encoder``, ``ids_col`` holds texts and the encoder, in the same task, adds ``ids`` to batches of ``id, text``.
    An id outside the vocabulary is an error.  Other columns are not read.  Results depend on how the input is cut into tasks, as every task packs its own rows.
    """
    if length < 1:
        raise ValueError("a row must hold a token")
    kind = np.uint16 if vocabulary <= 1 << 16 else np.uint32

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        number = (context.partitionId() if context else 0) << 33
        first, held, size = number, [], 0
        for batch in encoder(batches) if encoder else batches:
            values = batch.column("ids")
            for name, ids in zip(batch.column("id").to_pylist(), values):
                found = ids.values.to_numpy(zero_copy_only=False) if ids.is_valid else ()
                if len(found):
                    if found.min() < 0 or found.max() >= vocabulary:
                        raise ValueError("a token id lies outside the vocabulary")
                    held.append((name, number, found))
                    size += len(found)
                number += 1
                if size >= block_tokens:
                    yield (out := _block(held, length, pad, kind, first))
                    first, held, size = first + out.num_rows, [], 0
        if held:
            yield _block(held, length, pad, kind, first)

    ids = F.col(ids_col).alias("text") if encoder else F.col(ids_col).cast("array<int>").alias("ids")
    narrow = rows.select(F.col(id_col).cast("long").alias("id"), ids)
    return narrow.mapInArrow(run, _SCHEMA)


def unpack(packed: DataFrame, vocabulary: int = 1 << 16) -> DataFrame:
    """``doc_row, doc_id, doc_part, ids``: the segments of packed rows, for putting documents together again."""
    kind = np.uint16 if vocabulary <= 1 << 16 else np.uint32
    types = [pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int32())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.select(["ids", "cu_seqlens", "doc_ids", "doc_rows", "doc_parts"]).to_pylist():
                ids, ends = np.frombuffer(row["ids"], kind), row["cu_seqlens"]
                for a, b, *names in zip(ends, ends[1:], row["doc_rows"], row["doc_ids"], row["doc_parts"]):
                    out.append((*names, ids[a:b].astype(np.int32)))
            if out:
                columns = [pa.array(c, t) for c, t in zip(zip(*out), types)]
                yield pa.RecordBatch.from_arrays(columns, ["doc_row", "doc_id", "doc_part", "ids"])

    return packed.mapInArrow(run, "doc_row long, doc_id long, doc_part int, ids array<int>")


def write_packed(packed: DataFrame, path: str) -> None:
    """Write packed rows as Parquet; each file is a run of matrix lines with their cumulative lengths and positions."""
    packed.write.parquet(path)
