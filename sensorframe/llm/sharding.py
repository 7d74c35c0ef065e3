"""Sharding by jump consistent hashing, in DataFrame expressions alone.

The generator of the published algorithm is a 64-bit linear congruence.  Column arithmetic checks
for overflow, so the state is kept as two 32-bit halves and multiplied by pieces that stay
below 2**53.  One fold gives the shard for both shard counts, because a jump sequence does not
depend on the count: the shard is the last landing place below it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from sensorframe.plans.sizing import store

# fixed values of the algorithm: multiplier of the generator and the scale of its upper 31 bits
MULTIPLIER = 2862933555777941757
SCALE = 1 << 31

_LOW = 0xFFFFFFFF


def _long(value: int) -> Column:
    return F.lit(value).cast("long")


def _step(hi: Column, lo: Column) -> tuple[Column, Column]:
    """``(hi, lo) * MULTIPLIER + 1`` modulo 2**64, as halves."""
    m_hi, m_lo = MULTIPLIER >> 32, MULTIPLIER & _LOW

    def times(half: Column, factor: int) -> tuple[Column, Column]:
        """Lower 48-bit-safe part and the part that counts in units of 2**32 of ``half * factor``."""
        upper = half * _long(factor >> 16)
        low = half * _long(factor & 0xFFFF) + F.shiftleft(upper.bitwiseAND(_long(0xFFFF)), 16)
        return low, F.shiftright(upper, 16)

    low, carry = times(lo, m_lo)
    low = low + _long(1)
    cross = times(hi, m_lo)[0] + times(lo, m_hi)[0]
    high = cross + carry + F.shiftright(low, 32)
    return high.bitwiseAND(_long(_LOW)), low.bitwiseAND(_long(_LOW))


def jump(key: Column, counts: list[int]) -> Column:
    """Struct ``s0, s1, ...``: the shard of a 64-bit ``key`` among each of ``counts`` shards.

    The fold makes at most ``max(counts)`` jumps, as every jump goes up by one at least.
    """
    last = max(counts)
    names = [f"s{i}" for i in range(len(counts))]
    start = F.struct(
        F.shiftrightunsigned(key, 32).alias("hi"),
        key.bitwiseAND(_long(_LOW)).alias("lo"),
        _long(0).alias("j"),
        *[_long(0).alias(n) for n in names],
    )

    def go(state: Column, _: Column) -> Column:
        hi, lo = _step(state["hi"], state["lo"])
        # j was reached; the next landing place follows from the upper 31 bits of the new state
        ahead = F.floor((state["j"] + 1) * F.lit(float(SCALE)) / (F.shiftright(hi, 1) + 1).cast("double"))
        on = state["j"] < last
        return F.when(
            on,
            F.struct(
                hi.alias("hi"),
                lo.alias("lo"),
                F.least(ahead, _long(last)).alias("j"),
                *[F.when(state["j"] < n, state["j"]).otherwise(state[c]).alias(c) for c, n in zip(names, counts)],
            ),
        ).otherwise(state)

    def shards(state: Column) -> Column:
        return F.struct(*[state[n].cast("int").alias(n) for n in names])

    return F.aggregate(F.sequence(F.lit(0), F.lit(last)), start, go, shards)


def assign(docs: DataFrame, shards: int, key: str = "doc_id", grown: int | None = None) -> DataFrame:
    """Add ``shard`` (0 to ``shards - 1``) and, for another count, ``grown_shard``.

    Keys of any type are hashed to 64 bits first; equal keys share a shard, null keys share one.
    Growing from ``shards`` to ``grown`` moves rows only into the new shards.  Existing columns of
    these names are replaced; an empty table stays empty.
    """
    if shards < 1 or (grown is not None and grown < 1):
        raise ValueError("a shard count must be positive")
    landed = docs.withColumn("_jump", jump(F.xxhash64(F.col(key)), [shards, grown or shards]))
    out = landed.withColumn("shard", F.col("_jump.s0"))
    if grown is not None:
        out = out.withColumn("grown_shard", F.col("_jump.s1"))
    return out.drop("_jump")


def number(rows: DataFrame, shard: str = "shard", out: str = "slot") -> DataFrame:
    """Gapless positions from 0 in every shard, in the order of the stored rows.

    Rows are stored once; each stored part numbers its own rows of a shard, and the parts'
    counts (one row per part and shard) give the offsets, so no task sees a whole shard.
    """
    laid = store(rows.withColumn("_seq", F.monotonically_increasing_id()))
    laid = laid.withColumn("_part", F.shiftright("_seq", 33))
    counts = laid.groupBy(shard, "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(shard).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(shard, "_part", F.coalesce(F.sum("_n").over(before), _long(0)).alias("_offset"))
    local = F.row_number().over(Window.partitionBy(shard, "_part").orderBy("_seq")) - 1
    return (
        laid.withColumn(out, local)
        .join(offsets, [shard, "_part"])
        .withColumn(out, (F.col(out) + F.col("_offset")).cast("long"))
        .drop("_seq", "_part", "_offset")
    )


def place(docs: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text", grown: int | None = None) -> DataFrame:
    """``id_col, size, text_crc32, law, shard, slot, grown_shard`` for every row of ``docs``.

    ``size`` is the UTF-8 length of the text plus 16; a null text counts as empty (CRC 0).  Other
    columns are not read.  Repeated rows keep a slot each.
    """
    body = F.coalesce(F.col(text_col), F.lit(""))
    narrow = docs.select(
        F.col(id_col),
        (F.octet_length(body) + 16).cast("long").alias("size"),
        F.crc32(F.encode(body, "UTF-8")).alias("text_crc32"),
        F.lit("key").alias("law"),
    )
    placed = assign(narrow, shards, id_col, grown if grown is not None else shards + 1)
    return number(placed).select(id_col, "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def write_shards(docs: DataFrame, path: str, shards: int, key: str = "doc_id") -> None:
    """Write all columns as Parquet, one folder per shard; a large shard becomes several files."""
    assign(docs, shards, key).write.partitionBy("shard").parquet(path)
