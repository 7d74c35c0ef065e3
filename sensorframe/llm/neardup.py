"""Near duplicates: b-bit MinHash signatures, joined by a multi-index Hamming search.

A signature has ``chunks * symbols`` positions of 16 bits.  Two signatures that differ in at
most ``2 * chunks - 1`` positions have, by the pigeonhole principle, a chunk with at most one
differing position, so that chunk agrees once the right position is left out.  Every text
is therefore indexed under each chunk with each single position left out, and all pairs up
to that distance share a key.  (At a similarity of exactly 0.8 a position differs with
probability 0.2; a pair has no such chunk with probability 8e-9.)

Keys are not expanded into pairs.  First every member of a key is compared with the key's smallest
member; confirmed links give components.  Only keys whose members still lie in different
components are looked at again, pair by pair across components, where a pair is skipped if its
Jaccard distances to the common smallest member already rule it out (the distance is a metric)
or its signatures differ too much.  Links are confirmed on whole shingle sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from sensorframe.llm import text as tx
from sensorframe.llm.graph import components
from sensorframe.plans.sizing import BROADCAST_ROWS, store

CHUNKS, SYMBOLS = 14, 5
#: positions by which the signatures of a pair may differ; at similarity 0.8 more than 36 of 70 has probability 1e-9
MOST_APART = 36
#: shingles of a text are counted in this many cells; the cell-wise minima bound what two texts share
CELLS = 256
KEYS = "cid long, keys array<long>, whole array<long>"


class Shingler:
    """Distinct hashed shingles of every row of a slice."""

    def __init__(self, n: int) -> None:
        self.n, self.hasher = n, tx.WordHasher(n, lower=True)

    def __call__(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sorted distinct hashes per row and where each row begins (one more at the end)."""
        start, end, first = tx.find_words(data, offsets)
        words = self.hasher(data, start, end)
        count = np.diff(first)
        doc = np.repeat(np.arange(len(count)), count)
        whole = np.arange(len(words)) + self.n <= first[doc + 1]
        at = np.flatnonzero(whole)
        hashes, owner = tx.windows(words, self.n)[at], doc[at]
        short = np.flatnonzero((count > 0) & (count < self.n))
        if len(short):  # the whole sequence is the one shingle
            few = [tx.windows(words[first[r] : first[r + 1]], int(count[r]))[0] ^ tx.U(count[r]) for r in short.tolist()]
            hashes, owner = np.concatenate((hashes, np.array(few, tx.U))), np.concatenate((owner, short))
        order = np.lexsort((hashes, owner))
        hashes, owner = hashes[order], owner[order]
        fresh = np.ones(len(hashes), bool)
        fresh[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
        hashes, owner = hashes[fresh], owner[fresh]
        return hashes, np.searchsorted(owner, np.arange(len(count) + 1))


def _signatures(shingle: int):
    positions = CHUNKS * SYMBOLS
    factors, shifts = tx.constants(71, positions), tx.constants(72, positions)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(shingle)
        for batch in batches:
            data, offsets = tx.buffers(batch.column("text"))
            for i, j in tx.slices(offsets):
                hashes, begin = shingler(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                size = np.diff(begin)
                some = np.flatnonzero(size)
                signature = np.zeros((j - i, positions), np.uint16)
                names = np.zeros((j - i, 2), tx.U)
                if len(some):
                    for k in range(positions):
                        least = np.minimum.reduceat((hashes ^ shifts[k]) * factors[k], begin[some])
                        signature[some, k] = (tx.mix(least) >> tx.U(48)).astype(np.uint16)
                    for k in range(2):
                        names[some, k] = tx.mix(np.add.reduceat(tx.mix(hashes + shifts[k]), begin[some]))
                yield pa.RecordBatch.from_arrays(
                    [
                        *[batch.column(c).slice(i, j - i) for c in ("id", "t1", "t2")],
                        pa.array(size, pa.int64()),
                        pa.array(names[:, 0].view(np.int64)),
                        pa.array(names[:, 1].view(np.int64)),
                        pa.array([s.tobytes() for s in signature], pa.binary()),
                    ],
                    ["id", "t1", "t2", "n", "s1", "s2", "sig"],
                )

    return run


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One 64-bit key per chunk and left-out position (numbered in its lowest 7 bits), and a hash of every whole chunk."""
    number = np.arange(CHUNKS * SYMBOLS, dtype=tx.U)
    salts = tx.constants(73, CHUNKS * SYMBOLS).reshape(CHUNKS, SYMBOLS)
    for batch in batches:
        for piece in (batch.slice(k, 2000) for k in range(0, batch.num_rows, 2000)):
            raw = b"".join(piece.column("sig").to_pylist())
            sig = np.frombuffer(raw, np.uint16).reshape(-1, CHUNKS, SYMBOLS).astype(tx.U)
            keys = np.empty((len(sig), CHUNKS, SYMBOLS), tx.U)
            for out in range(SYMBOLS):
                rest = [p for p in range(SYMBOLS) if p != out]
                packed = np.zeros((len(sig), CHUNKS), tx.U)
                for p in rest:
                    packed = (packed << tx.U(16)) | sig[:, :, p]
                keys[:, :, out] = tx.mix(packed ^ salts[:, out])
            whole = tx.mix(keys[:, :, 0] + tx.mix(sig[:, :, 0] + tx.U(1)))
            keys = keys.reshape(len(sig), -1) & ~tx.U(127) | number
            columns = [
                pa.ListArray.from_arrays(
                    pa.array(np.arange(len(sig) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.reshape(-1).view(np.int64))
                )
                for x in (keys, whole)
            ]
            yield pa.RecordBatch.from_arrays([piece.column("cid"), *columns], ["cid", "keys", "whole"])


def _sets(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(shingle)
        for batch in batches:
            data, offsets = tx.buffers(batch.column("text"))
            for i, j in tx.slices(offsets):
                hashes, begin = shingler(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                lists = pa.ListArray.from_arrays(pa.array(begin.astype(np.int32)), pa.array(hashes.view(np.int64)))
                owner = np.repeat(np.arange(j - i), np.diff(begin))
                tally = np.bincount(owner * CELLS + (hashes >> tx.U(56)).astype(np.int64), minlength=(j - i) * CELLS)
                tally = tally.reshape(-1, CELLS)
                tally[tally.max(axis=1) > 32767] = 32767  # no bound for such a text
                cells = pa.ListArray.from_arrays(
                    pa.array(np.arange(j - i + 1, dtype=np.int32) * CELLS), pa.array(tally.reshape(-1).astype(np.int16))
                )
                columns = [batch.column("cid").slice(i, j - i), lists, cells]
                yield pa.RecordBatch.from_arrays(columns, ["cid", "shingles", "cells"])

    return run


def _shingle_sets(pairs: DataFrame, docs: DataFrame, reps: DataFrame, shingle: int) -> DataFrame:
    """Stored ``(cid, shingles, cells)`` of the texts that occur in a pair."""
    involved = store(pairs.select(F.col("a").alias("cid")).union(pairs.select("b")).distinct())
    few = involved.count() <= BROADCAST_ROWS
    wanted = reps.select("cid", "first.*").join(F.broadcast(involved) if few else involved, "cid")
    wanted = wanted.select("cid", F.col("id").alias("_id"), "t1", "t2")
    wanted = F.broadcast(wanted) if few else wanted
    texts = docs.join(wanted, (docs.t1 == wanted.t1) & (docs.t2 == wanted.t2) & docs.id.eqNullSafe(wanted._id))
    sets = texts.select("cid", "text").mapInArrow(_sets(shingle), "cid long, shingles array<long>, cells array<smallint>")
    one = sets.groupBy("cid").agg(F.first(F.struct("shingles", "cells")).alias("set"))  # repeated rows give one set
    return store(one.select("cid", "set.*"))


def _confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Stored ``(a, b, shared, together, linked)`` from whole sets."""
    left = sets.select(F.col("cid").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("cid").alias("b"), F.col("shingles").alias("sb"))
    counted = (
        pairs.join(left, "a")
        .join(right, "b")
        .select("a", "b", F.size(F.array_intersect("sa", "sb")).alias("shared"), (F.size("sa") + F.size("sb")).alias("both"))
        .select("a", "b", "shared", (F.col("both") - F.col("shared")).alias("together"))
    )
    return store(counted.withColumn("linked", F.lit(100) * F.col("shared") >= F.lit(percent) * F.col("together")))


def _across(
    members: DataFrame, known: DataFrame, roots: DataFrame, reps: DataFrame, sets: DataFrame, percent: int
) -> DataFrame:
    """Pairs of different components under one key that could still be links.

    Shingles that no other text in question holds cannot be shared: what is left of a text bounds its
    similarity to every partner, which rules out heavily edited copies before any pair is formed.  A pair is
    formed only if the counts of shingles per cell admit the similarity, which loses no link, and if the signatures differ in
    at most ``MOST_APART`` positions.
    """
    placed = members.join(roots.select(F.col("node").alias("cid"), "root"), "cid", "left")
    placed = placed.select("key", "head", "cid", F.coalesce("root", "cid").alias("root"))
    split = placed.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo < hi")
    placed = store(placed.join(split.select("key"), "key"))
    asked = sets.join(placed.select("cid").distinct(), "cid")
    holders = asked.select("cid", F.explode("shingles").alias("s")).groupBy("s")
    alone = holders.agg(F.count(F.lit(1)).alias("texts"), F.min("cid").alias("cid")).filter("texts = 1")
    alone = alone.groupBy("cid").agg(F.count(F.lit(1)).alias("own"))
    sized = asked.select("cid", F.size("shingles").alias("n"), "cells").join(alone, "cid", "left")
    sized = sized.select("cid", "n", "cells", (F.col("n") - F.coalesce("own", F.lit(0))).alias("m"))
    sized = sized.filter(F.lit(100) * F.col("m") >= F.lit(percent) * F.col("n"))
    far = known.select(
        F.col("a").alias("head"), F.col("b").alias("cid"), (1 - F.col("shared") / F.col("together")).alias("far")
    )
    wholes = reps.join(asked.select("cid"), "cid", "left_semi").mapInArrow(_keys, KEYS).select("cid", "whole")
    wholes = wholes.join(reps.select("cid", "sig"), "cid")
    placed = placed.join(sized.join(wholes, "cid"), "cid").withColumn("at", F.col("key").bitwiseAND(F.lit(127)).cast("int"))
    placed = store(placed.join(far, ["head", "cid"], "left").fillna(0.0, ["far"]))
    one, two = placed.alias("one"), placed.alias("two")
    differ = F.expr("one.key = two.key AND one.root < two.root AND one.cid <> one.head AND two.cid <> two.head")
    least = F.lit(percent) * (F.col("one.n") + F.col("two.n"))
    fits = F.lit(100 + percent) * F.least("one.m", "two.m") >= least
    cellwise = F.aggregate(F.zip_with("one.cells", "two.cells", lambda a, b: F.least(a, b)), F.lit(0), lambda total, c: total + c.cast("int"))
    close = F.abs(F.col("one.far") - F.col("two.far")) <= F.lit(1 - percent / 100 + 1e-9)
    # a pair that shares several keys is formed under few: none after the first chunk that agrees whole, and one for that
    early = F.expr(
        f"NOT exists(zip_with(slice(one.whole, 1, CAST(one.at div {SYMBOLS} AS INT)), slice(two.whole, 1, CAST(one.at div {SYMBOLS} AS INT)), "
        f"(x, y) -> x = y), z -> z) AND (one.at % {SYMBOLS} = 0 "
        f"OR element_at(one.whole, 1 + CAST(one.at div {SYMBOLS} AS INT)) <> element_at(two.whole, 1 + CAST(one.at div {SYMBOLS} AS INT)))"
    )
    apart = F.expr(
        f"size(filter(sequence(1, {2 * SYMBOLS * CHUNKS}, 2), i -> substring(one.sig, i, 2) <> substring(two.sig, i, 2))) <= {MOST_APART}"
    )
    pairs = (
        one.join(two, differ & fits & close & early & (F.lit(100 + percent) * cellwise >= least) & apart)
        .select(F.least("one.cid", "two.cid").alias("a"), F.greatest("one.cid", "two.cid").alias("b"))
        .distinct()
    )
    return store(pairs)


def clusters(
    docs: DataFrame, shingle: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Near-duplicate groups: ``id``, ``t1``, ``t2`` (hashes of the text), ``n_shingles``, ``component_id``, ``first``.

    Texts are lower-cased (A-Z), cut into words at white space and shingled by ``shingle`` words
    (a shorter text is one shingle).  Texts are linked if ``100 * shared >= percent * union``;
    components are those of the links; ``component_id`` is the smallest id of the component;
    ``first`` marks one (id, text) of it.  One row per input row.  A null, empty or blank text has
    no shingles and is a component of its own; ids may be null (such rows never name a
    component that has another id) or repeated; other columns are not read.
    """
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    base = base.select("*", F.xxhash64("text").alias("t1"), F.xxhash64(F.lit(1), "text").alias("t2"))
    signed = store(
        base.mapInArrow(_signatures(shingle), "id long, t1 long, t2 long, n long, s1 long, s2 long, sig binary")
    )
    order = F.struct(F.col("id").isNull().alias("no"), "id", "t1", "t2")
    reps = store(
        signed.filter("n > 0")
        .groupBy("s1", "s2", "n")
        .agg(F.min(order).alias("first"), F.first("sig").alias("sig"))
        .withColumn("cid", F.monotonically_increasing_id())
    )
    keys = reps.mapInArrow(_keys, KEYS).select(F.explode("keys").alias("key"), "cid")
    heads = keys.groupBy("key").agg(F.min("cid").alias("head"), F.max("cid").alias("last")).filter("head < last")
    members = store(keys.join(heads.select("key", "head"), "key"))
    stars = members.filter("cid <> head").select(F.col("head").alias("a"), F.col("cid").alias("b")).distinct()
    stars = store(stars)
    sets = _shingle_sets(stars, base, reps, shingle)
    known = _confirm(stars, sets, percent)
    roots = components(known.filter("linked"))
    pairs = _across(members, known, roots, reps, sets, percent)
    if not pairs.isEmpty():
        late = _confirm(pairs, sets, percent).filter("linked")
        if not late.isEmpty():
            roots = components(known.filter("linked").select("a", "b").union(late.select("a", "b")))
    placed = reps.join(roots.withColumnRenamed("node", "cid"), "cid", "left")
    placed = placed.select("s1", "s2", "n", "first", F.coalesce("root", "cid").alias("root"))
    named = placed.groupBy("root").agg(F.min("first").alias("head"))
    placed = placed.join(named, "root").select("s1", "s2", "n", "head")
    own = F.when(F.col("n") == 0, order).otherwise(F.col("head"))
    return (
        signed.join(placed, ["s1", "s2", "n"], "left")
        .withColumn("head", own)
        .select(
            "id",
            "t1",
            "t2",
            F.col("n").alias("n_shingles"),
            F.col("head.id").alias("component_id"),
            order.eqNullSafe(F.col("head")).alias("first"),
        )
    )


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``n_shingles``, ``component_id``, ``kept`` (the id names its component) per row; see :func:`clusters`."""
    found = clusters(docs, shingle, percent, id_col, text_col)
    return found.select(
        F.col("id").alias(id_col), "n_shingles", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept")
    )


def keep_one(docs: DataFrame, shingle: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, with one row for each near-duplicate group.

    Rows repeated with the same id and text count as one; empty texts all stay.
    """
    firsts = clusters(docs, shingle, percent, id_col, text_col).filter("first")
    firsts = store(firsts.groupBy("id", "t1", "t2").agg(F.count(F.lit(1)).alias("times")))
    body = F.coalesce(F.col(text_col), F.lit(""))
    keys = {"_id": F.col(id_col).cast("long"), "_t1": F.xxhash64(body), "_t2": F.xxhash64(F.lit(1), body)}
    left = docs.withColumns(keys)
    right = firsts.select(F.col("id").alias("_a"), F.col("t1").alias("_b"), F.col("t2").alias("_c"))
    kept = left.join(right, F.expr("_id <=> _a AND _t1 = _b AND _t2 = _c"), "left_semi")
    if not firsts.filter("times > 1").isEmpty():
        kept = kept.dropDuplicates(["_id", "_t1", "_t2"])
    return kept.select(*docs.columns)
