"""Substring deduplication by level-wise doubling.

A window of ``window`` words is a repeat if its word sequence starts anywhere else.  Lengths
double from about ``base`` words up to ``window`` (35: 18, 35).  Below the full length each
full window is represented by its smallest shorter window, which equal windows share, so that
a fraction of the positions is counted; only windows whose representatives repeat at
one length go on to the next.  At the full length every remaining window is counted.

Counting never brings all occurrences of one sequence together.  Hashes travel as binary
arrays per (text, bucket); buckets above a target size are salted, each salt reports distinct
hashes, and the merged list of repeats goes back to the salts, which answer with bit masks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from sensorframe.llm import text as tx
from sensorframe.plans.sizing import store

TARGET = 1 << 21  # hashes counted in one task
KEY = ["_k1", "_k2"]


def lengths(window: int, base: int = 18) -> list[int]:
    """Doubling lengths that end with ``window``; the first is at most ``base``."""
    out = [window]
    while out[0] > base:
        out.insert(0, -(-out[0] // 2))
    return out


class _Part:
    """Some rows of a batch at once: words, their hashes, and the windows still in question."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, window: int, hasher: tx.WordHasher) -> None:
        self.start, self.end, self.first = tx.find_words(data, offsets)
        self.words, self.window = hasher(data, self.start, self.end), window
        n = len(self.words)
        self.doc = np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))
        self.alive = np.arange(n) + window <= self.first[self.doc + 1]

    def chosen(self, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hashes to count at ``length``, their rows, and for every live window which hash stands for it."""
        at = np.flatnonzero(self.alive)
        if not len(at):
            return np.empty(0, tx.U), at, at
        hashes, doc = tx.windows(self.words, length), self.doc[at]
        if length == self.window:
            return hashes[at], doc, np.arange(len(at))
        least = tx.sliding_min_at(hashes, self.window - length + 1)[at]
        fresh = np.concatenate(([True], (least[1:] != least[:-1]) | (doc[1:] != doc[:-1])))
        return hashes[least[fresh]], doc[fresh], np.cumsum(fresh) - 1

    def settle(self, length: int, buckets: int, masks: dict[int, bytes]) -> None:
        """Keep the windows whose hash the masks (by row * buckets + bucket) call repeated."""
        hashes, doc, stands = self.chosen(length)
        order, group, begin = _dealt(hashes, doc, buckets)
        repeat = np.zeros(len(hashes), bool)
        for k, g in enumerate(group.tolist()):
            if g in masks:
                bits = np.unpackbits(np.frombuffer(masks[g], np.uint8), count=begin[k + 1] - begin[k])
                repeat[order[begin[k] : begin[k + 1]]] = bits
        self.alive[self.alive] = repeat[stands]


def _dealt(hashes: np.ndarray, doc: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order by (row, bucket), the groups present as row * buckets + bucket, and where each begins."""
    key = doc * buckets + (hashes % tx.U(buckets)).astype(np.int64)
    order = np.argsort(key, kind="stable")
    group, begin = np.unique(key[order], return_index=True)
    return order, group, np.append(begin, len(hashes))


def _parts(batches: Iterator[pa.RecordBatch], window: int, sizes: list[int], buckets: int, known: int):
    """``(batch, first row, bytes, part)`` with the masks of the first ``known`` lengths applied."""
    hasher = tx.WordHasher(35)
    for batch in batches:
        data, offsets = tx.buffers(batch.column("text"))
        for i, j in tx.slices(offsets):
            part = _Part(piece := data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], window, hasher)
            for level in range(known):
                masks = {}
                for r, answer in enumerate(batch.column(f"_f{level}").slice(i, j - i).to_pylist()):
                    for a in answer or ():
                        masks[r * buckets + a["b"]] = a["m"]
                part.settle(sizes[level], buckets, masks)
            yield batch, i, piece, part


def _batched(rows: Iterator[tuple[int, tuple]], schema: pa.Schema, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Record batches of about ``most`` bytes from ``(bytes, row)``."""
    held: list[tuple] = []
    size = 0
    for n, row in rows:
        held.append(row)
        size += n
        if size > most or len(held) >= 50_000:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)


_ROWS = pa.schema([("_k1", pa.int64()), ("_k2", pa.int64()), ("b", pa.int64()), ("h", pa.binary())])
_MASKS = pa.schema([("_k1", pa.int64()), ("_k2", pa.int64()), ("b", pa.int64()), ("m", pa.binary())])
_DISTINCT = pa.schema([("b", pa.int64()), ("h", pa.binary()), ("twice", pa.binary())])
_REPEATS = pa.schema([("b", pa.int64()), ("rep", pa.binary())])
_CLEANED = pa.schema([("id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_text", pa.string())])


def _emit(window: int, sizes: list[int], level: int, buckets: int):
    def rows(batches):
        for batch, i, _, part in _parts(batches, window, sizes, buckets, level):
            hashes, doc, _ = part.chosen(sizes[level])
            order, group, begin = _dealt(hashes, doc, buckets)
            dealt = hashes[order]
            k1, k2 = (batch.column(k).slice(i, len(part.first) - 1).to_pylist() for k in KEY)
            for k, g in enumerate(group.tolist()):
                r, b = divmod(g, buckets)
                held = dealt[begin[k] : begin[k + 1]].tobytes()
                yield len(held), (k1[r], k2[r], b, held)

    return lambda batches: _batched(rows(batches), _ROWS)


def _clean(window: int, sizes: list[int], buckets: int):
    def rows(batches):
        for batch, i, piece, part in _parts(batches, window, sizes, buckets, len(sizes)):
            change = np.zeros(len(part.words) + 1, np.int64)
            at = np.flatnonzero(part.alive)
            change[at] += 1
            change[at + window] -= 1
            keep = np.cumsum(change[:-1]) == 0
            kept = np.concatenate(([0], np.cumsum(keep)))[part.first].tolist()
            spans = list(zip(part.start[keep].tolist(), part.end[keep].tolist()))
            counts, raw = np.diff(part.first).tolist(), piece.tobytes()
            for r, name in enumerate(batch.column("id").slice(i, len(counts)).to_pylist()):
                body = b" ".join([raw[a:b] for a, b in spans[kept[r] : kept[r + 1]]])
                n = counts[r]
                yield len(body), (name, n, n - kept[r + 1] + kept[r], body.decode("utf-8", "replace"))

    return lambda batches: _batched(rows(batches), _CLEANED)


def _joined(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All hashes of a binary column, and where each row begins."""
    parts = [np.frombuffer(x, tx.U) for x in column.to_pylist()]
    return (np.concatenate(parts) if parts else np.empty(0, tx.U)), np.cumsum([0, *map(len, parts)])


def _distinct(table: pa.Table) -> pa.Table:
    hashes, count = np.unique(_joined(table.column("h"))[0], return_counts=True)
    row = {"b": table.column("b")[0].as_py(), "h": hashes.tobytes(), "twice": hashes[count > 1].tobytes()}
    return pa.Table.from_pylist([row], _DISTINCT)


def _repeats(table: pa.Table) -> pa.Table:
    hashes, count = np.unique(_joined(table.column("h"))[0], return_counts=True)
    found = np.union1d(hashes[count > 1], _joined(table.column("twice"))[0])
    return pa.Table.from_pylist([{"b": table.column("b")[0].as_py(), "rep": found.tobytes()}], _REPEATS)


def _answer(rows: pa.Table, repeats: pa.Table) -> pa.Table:
    rep = _joined(repeats.column("rep"))[0]
    hashes, begin = _joined(rows.column("h"))
    if not len(rep) or not len(hashes):
        return _MASKS.empty_table()
    at = np.minimum(np.searchsorted(rep, hashes), len(rep) - 1)
    found = rep[at] == hashes
    some = np.flatnonzero(np.add.reduceat(found, begin[:-1]) > 0)
    picked = rows.take(pa.array(some, pa.int64()))
    masks = [np.packbits(found[begin[k] : begin[k + 1]]).tobytes() for k in some.tolist()]
    return pa.table([picked.column("_k1"), picked.column("_k2"), picked.column("b"), pa.array(masks, pa.binary())], _MASKS)


def repeated(rows: DataFrame, target: int = TARGET) -> DataFrame:
    """For stored rows ``(_k1, _k2, b, h)``: masks of the hashes that occur at least twice in their bucket.

    Rows without such a hash are left out; rows of equal texts give equal masks and appear once.
    """
    fullest = rows.groupBy("b").agg(F.sum(F.octet_length("h")).alias("n")).agg(F.max("n")).first()[0] or 0
    salts = max(1, -(-fullest // (8 * 4 * target)))
    salted = rows.withColumn("s", F.pmod(F.monotonically_increasing_id(), F.lit(salts).cast("long")))
    distinct = salted.groupBy("b", "s").applyInArrow(_distinct, "b long, h binary, twice binary")
    repeats = distinct.groupBy("b").applyInArrow(_repeats, "b long, rep binary")
    spread = repeats.withColumn("s", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    masks = (
        salted.groupBy("b", "s")
        .cogroup(spread.groupBy("b", "s"))
        .applyInArrow(_answer, "_k1 long, _k2 long, b long, m binary")
    )
    return masks.groupBy(*KEY, "b").agg(F.first("m").alias("m"))


def remove_repeats(
    docs: DataFrame,
    window: int = 35,
    id_col: str = "doc_id",
    text_col: str = "text",
    base: int = 18,
    target: int = TARGET,
) -> DataFrame:
    """Remove every word covered by a window of ``window`` words that also starts anywhere else.

    Returns ``id_col``, ``n_words``, ``n_removed`` and ``kept_text`` (kept words joined by one
    space), one row per input row; other columns are neither read nor returned.  A null or empty text
    has no words and gives an empty ``kept_text``; a text of fewer than ``window`` words
    keeps all; repeated rows are copies of each other, so their windows repeat; ids
    may be null or repeated.  Sequences are compared by 64-bit hashes at every length.
    """
    sizes = lengths(window, base)
    data = docs.select(
        F.col(id_col).cast("long").alias("id"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    ).select("*", F.xxhash64("text").alias("_k1"), F.xxhash64(F.lit(35), "text").alias("_k2"))
    size = data.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(12, size // (28 * target))
    final = data
    for level in range(len(sizes)):
        emitted = data.mapInArrow(_emit(window, sizes, level, buckets), "_k1 long, _k2 long, b long, h binary")
        masks = store(repeated(store(emitted), target))
        if masks.isEmpty():
            final = final.select("*", *[F.lit(None).cast("array<struct<b:long,m:binary>>").alias(f"_f{i}") for i in range(level, len(sizes))])
            break
        answer = masks.groupBy(*KEY).agg(F.collect_list(F.struct("b", "m")).alias(f"_f{level}"))
        data = data.join(answer, KEY)
        final = final.join(answer, KEY, "left")
    cleaned = final.mapInArrow(_clean(window, sizes, buckets), "id long, n_words long, n_removed long, kept_text string")
    return cleaned.withColumnRenamed("id", id_col)
