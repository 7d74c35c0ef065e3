"""Document fingerprints from closed syncmers.

A k-mer (``K`` bytes of UTF-8) is a closed syncmer if the smallest hash among its inner s-mers stands at
either edge.  Whether it is chosen depends on its own bytes alone, so a shared passage yields the same anchors
wherever it stands.  A fingerprint keeps all anchors in a fixed share of the hash range, so it grows with the text,
and at least the ``ANCHORS`` smallest ones, in the order of their positions and with them.  Likeness matches positions:
common anchors count as far as they stand in one order and at the same distances.
"""

from __future__ import annotations

import bisect
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from sensorframe.llm import text as tx
from sensorframe.plans.sizing import store

K, S = 12, 4
#: anchors that every text keeps (all, if it has fewer), and the share of the hash range kept beyond them
ANCHORS, SHARE = 32, 16
LIMIT = (1 << 32) // SHARE
#: rows of one range in the ordered pass
RANGE_ROWS = 20_000

_BASE = tx.U(0x9E3779B97F4A7C15)


def _rolling(values: np.ndarray, width: int) -> np.ndarray:
    """Mixed hashes of all ``width``-byte substrings (width at most 8 packs them exactly)."""
    n = len(values) - width + 1
    packed = np.zeros(n, tx.U)
    for k in range(width):
        packed = packed * (tx.U(256) if width <= 8 else _BASE) + values[k : k + n]
    return tx.mix(packed ^ _BASE)


def syncmers(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the closed syncmers; a text shorter than ``K`` is one anchor."""
    if not data:
        return np.empty(0, np.int64), np.empty(0, tx.U)
    values = np.frombuffer(data, np.uint8).astype(tx.U)
    if len(values) < K:
        return np.zeros(1, np.int64), tx.mix(_rolling(values, len(values)) + tx.U(len(values)))
    inner = _rolling(values, S)
    width = K - S + 1
    least, done = inner, 1
    while done < width:
        step = min(done, width - done)
        least = np.minimum(least[step:], least[: len(least) - step])
        done += step
    n = len(least)
    at = np.flatnonzero((inner[:n] == least) | (inner[width - 1 :] == least))
    if not len(at):  # a closed syncmer may be missing in a text of few k-mers
        at = np.zeros(1, np.int64)
    ends = [inner[at], inner[at + (K - S) // 2], inner[at + K - S]]  # s-mers that cover the k-mer
    return at, tx.mix(tx.mix(ends[0] * _BASE + ends[1]) * _BASE + ends[2])


def fingerprint(data: bytes) -> bytes:
    """Anchors in the order of position: their number and hashes (32 bits each), then the gaps between positions
    (bytes, seven bits at a time, the lowest first)."""
    at, hashes = syncmers(data)
    if not len(at):
        return b""
    values, first = np.unique(hashes >> tx.U(32), return_index=True)  # by hash; of equal ones the first position
    upto = max(ANCHORS, int(np.searchsorted(values, tx.U(LIMIT))))
    chosen = np.sort(first[:upto])
    gaps = np.diff(at[chosen], prepend=0)
    width = 1 + sum((gaps >> (7 * k) > 0).astype(np.int64) for k in range(1, 5))
    owner = np.repeat(np.arange(len(gaps)), width)
    digit = np.arange(len(owner)) - (np.cumsum(width) - width)[owner]
    packed = (gaps[owner] >> (7 * digit) & 127) + 128 * (digit < width[owner] - 1)
    numbers = np.append(len(chosen), (hashes[chosen] >> tx.U(32)).astype(np.int64))
    return numbers.astype(">u4").tobytes() + packed.astype(np.uint8).tobytes()


def anchors(mark: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and byte positions of a fingerprint that is not empty."""
    n = int.from_bytes(mark[:4], "big")
    hashes = np.frombuffer(mark, ">u4", n, 4).astype(np.int64)
    packed = np.frombuffer(mark, np.uint8, offset=4 + 4 * n).astype(np.int64)
    ends = np.flatnonzero(packed < 128)
    starts = np.append(0, ends[:-1] + 1)
    digit = np.arange(len(packed)) - np.repeat(starts, ends - starts + 1)
    return hashes, np.cumsum(np.add.reduceat((packed & 127) << (7 * digit), starts))


def _bound(hashes: np.ndarray) -> int:
    """The hash up to which a fingerprint holds every anchor of its text."""
    return max(int(hashes.max()), LIMIT - 1) if len(hashes) >= ANCHORS else 1 << 32


def _in_order(places: list[int]) -> list[int]:
    """Indexes of a longest increasing run of ``places``."""
    ends: list[int] = []  # index of the least last place of a run of each length
    tails: list[int] = []
    before = [-1] * len(places)
    for i, place in enumerate(places):
        k = bisect.bisect_left(tails, place)
        tails[k : k + 1], ends[k : k + 1] = [place], [i]
        before[i] = ends[k - 1] if k else -1
    chain, i = [], ends[-1] if ends else -1
    while i >= 0:
        chain.append(i)
        i = before[i]
    return chain[::-1]


def likeness(one: bytes, two: bytes) -> float:
    """0 to 1; equal fingerprints give 1, an empty one is unlike every other.

    Anchors are compared up to the hash below which both sides hold all of theirs.  Of the common ones the longest
    chain in the same order counts, as a share of all anchors of both sides, times how well the distances between
    neighbours of the chain agree (mean of the smaller over the larger).
    """
    if one == two:
        return 1.0
    if not one or not two:
        return 0.0
    (hash_a, at_a), (hash_b, at_b) = anchors(one), anchors(two)
    limit = min(_bound(hash_a), _bound(hash_b))
    a, b = hash_a <= limit, hash_b <= limit
    common, in_a, in_b = np.intersect1d(hash_a[a], hash_b[b], assume_unique=True, return_indices=True)
    if not len(common):
        return 0.0
    order = np.argsort(in_a)  # anchors stand in the order of their places
    from_a, from_b = at_a[a][in_a[order]], at_b[b][in_b[order]]
    chain = _in_order(from_b.tolist())
    share = len(chain) / (int(a.sum()) + int(b.sum()) - len(common))
    if len(chain) == 1:
        return share
    far_a, far_b = np.diff(from_a[chain]), np.diff(from_b[chain])
    return share * float(np.mean(np.minimum(far_a, far_b) / np.maximum(far_a, far_b)))


_OUT = pa.schema(
    [
        ("id", pa.int64()),
        ("n_chars", pa.int64()),
        ("edited_sha256", pa.binary()),
        ("fingerprint", pa.binary()),
        ("edited_fingerprint", pa.binary()),
        ("near_edited", pa.float64()),
        ("near_next", pa.float64()),
        ("part", pa.int64()),
        ("head", pa.string()),
        ("tail", pa.string()),
    ]
)
_SCHEMA = (
    "id long, n_chars long, edited_sha256 binary, fingerprint binary, edited_fingerprint binary, "
    "near_edited double, near_next double, part long, head string, tail string"
)


def edit(text: str, following: str) -> str:
    """The second half of ``text`` (rounded down) replaced by as much of the start of ``following``."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _row(name: int | None, text: str, mark: bytes, following: str, next_mark: bytes) -> tuple:
    body = edit(text, following).encode()
    changed = fingerprint(body)
    digest = hashlib.sha256(body).digest()
    return name, len(text), digest, mark, changed, likeness(mark, changed), likeness(mark, next_mark), None, None, None


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _OUT.types)], schema=_OUT)


def _chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Compare the rows of a sorted partition with their successors.

    Ends with one row that carries the partition's first and last text for the comparison across partitions.
    """
    head, last = None, None
    for batch in batches:
        rows = []
        for name, text, part in zip(*(batch.column(c).to_pylist() for c in ("id", "text", "part"))):
            mark = fingerprint(text.encode())
            if last is None:
                head = text
            else:
                rows.append(_row(last[0], last[1], last[2], text, mark))
            last = (name, text, mark, part)
        if rows:
            yield _batch(rows)
    if last is not None:
        yield _batch([(last[0], None, None, None, None, None, None, last[3], head, last[1])])


def _bridge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [
            _row(name, tail, fingerprint(tail.encode()), head, fingerprint(head.encode()))
            for name, tail, head in zip(*(batch.column(c).to_pylist() for c in ("id", "tail", "head")))
        ]
        if rows:
            yield _batch(rows)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprint every text, its edited text and its likeness to that and to the next document.

    Columns: ``id_col``, ``n_chars`` (code points), ``edited_sha256``, ``fingerprint``, ``edited_fingerprint``, ``near_edited``,
    ``near_next``.  The next document follows in ascending id (ties by a hash of the text, null ids first); after
    the last comes the first, so a single row follows itself.  The edited text has its last half replaced by as much
    of the next document.  A null text is empty: fingerprint ``""``, which is like (1) another empty one only.
    Very long texts are read whole, and their fingerprints grow with them.  Repeated rows follow each other; an empty
    table gives no rows; other columns of ``docs`` are not read.

    Texts are shuffled once, into sorted ranges; each range compares its own neighbours and hands on its first
    and last text.
    """
    body = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), body.alias("text"))
    spark = docs.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), docs.count() // RANGE_ROWS + 1)
    rows = rows.withColumn("tie", F.xxhash64("text"))
    laid = rows.repartitionByRange(parts, "id", "tie").sortWithinPartitions("id", "tie")
    laid = laid.select("id", "text", F.spark_partition_id().cast("long").alias("part"))
    done = store(laid.mapInArrow(_chain, _SCHEMA))
    ends = done.filter("part IS NOT NULL")
    # one short row per range: which range follows, the first one after the last
    numbers = ends.select("part")
    order = numbers.select("part", F.lead("part").over(Window.orderBy("part")).alias("after"))
    first = numbers.agg(F.min("part").alias("start"))
    after = order.join(F.broadcast(first)).select("part", F.coalesce("after", "start").alias("after"))
    heads = ends.select(F.col("part").alias("after"), "head")
    bridged = ends.select("id", "part", "tail").join(after, "part").join(heads, "after").select("id", "tail", "head")
    whole = done.filter("part IS NULL").union(bridged.mapInArrow(_bridge, _SCHEMA))
    for c in ("edited_sha256", "fingerprint", "edited_fingerprint"):  # stored as bytes, half the size
        whole = whole.withColumn(c, F.lower(F.hex(c)))
    return whole.drop("part", "head", "tail").withColumnRenamed("id", id_col)
