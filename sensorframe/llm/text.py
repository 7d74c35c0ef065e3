"""Numpy kernels over the UTF-8 buffers of Arrow string columns.

Words are runs of bytes other than space and 0x09-0x0D; in UTF-8 these bytes never occur
inside a longer character, so splitting bytes and splitting characters agree.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20
U = np.uint64

_separator = np.zeros(256, bool)
_separator[[0x20, *range(0x09, 0x0E)]] = True
_lower = np.arange(256, dtype=np.uint8)
_lower[65:91] += 32


def constants(seed: int, n: int) -> np.ndarray:
    """``n`` odd 64-bit numbers that depend on ``seed`` alone."""
    return mix(np.arange(1, n + 1, dtype=U) * U(0x9E3779B97F4A7C15) + U(seed * 0xD1B54A32D192ED03 % (1 << 64))) | U(1)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every input bit over the output."""
    x = (x ^ (x >> U(32))) * U(0xD6E8FEB86659FD93)
    x = (x ^ (x >> U(32))) * U(0xD6E8FEB86659FD93)
    return x ^ (x >> U(32))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column and the offsets of its rows (a null row is empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    if len(column) == 0 or data is None:
        return np.empty(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offsets = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, size: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``size`` bytes; a longer row stands alone."""
    begin, rows = 0, len(offsets) - 1
    while begin < rows:
        end = int(np.searchsorted(offsets, offsets[begin] + size, "right")) - 1
        end = min(max(end, begin + 1), rows)
        yield begin, end
        begin = end


class WordHasher:
    """64-bit hashes of words: sums of per-byte constants times powers of an odd base."""

    def __init__(self, seed: int, lower: bool = False) -> None:
        self.table = constants(seed, 256)
        if lower:
            self.table = self.table[_lower]
        self.base = U(int(constants(seed + 1000, 1)[0]) | 5)
        self.inverse = U(pow(int(self.base), -1, 1 << 64))
        self.powers = self.inverses = np.ones(1, U)

    def _grow(self, n: int) -> None:
        if len(self.powers) < n:
            n = max(n, SLICE_BYTES + 1)
            self.powers = np.full(n, self.base, U)
            self.inverses = np.full(n, self.inverse, U)
            self.powers[0] = self.inverses[0] = 1
            np.cumprod(self.powers, out=self.powers)
            np.cumprod(self.inverses, out=self.inverses)

    def __call__(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        self._grow(len(data) + 1)
        sums = np.zeros(len(data) + 1, U)
        np.cumsum(self.table[data] * self.powers[: len(data)], out=sums[1:])
        return mix((sums[end] - sums[start]) * self.inverses[start])


def find_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word, and the number of the first word of each row (one more at the end)."""
    inside = ~_separator[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.concatenate(([False], inside[:-1])) & ~edge[:-1]
    after = np.concatenate((inside[1:], [False])) & ~edge[1:]
    start = np.flatnonzero(inside & ~before)
    end = np.flatnonzero(inside & ~after) + 1
    return start, end, np.searchsorted(start, offsets)


def windows(hashes: np.ndarray, length: int) -> np.ndarray:
    """Order-dependent hashes of all ``length`` consecutive values, by doubling."""
    if len(hashes) < length:
        return np.empty(0, U)
    out, have, level, done = None, 0, hashes, 1
    rest = length
    while rest:  # binary digits of the length: out covers the first `have` values
        if rest & 1:
            part = level
            if out is None:
                out = part
            else:
                n = min(len(out), len(part) - have)
                out = mix(out[:n] * U(0x9FB21C651E98DF25) + part[have : have + n] + U(done))
            have += done
        rest >>= 1
        if rest:
            level = mix(level[: len(level) - done] * U(0xA24BAED4963EE407) + level[done:] + U(done))
            done *= 2
    return out[: len(hashes) - length + 1]


def sliding_min_at(values: np.ndarray, width: int) -> np.ndarray:
    """Position of the smallest of each ``width`` consecutive values (of equal ones the first)."""
    best, at, done = values, np.arange(len(values)), 1
    while done < width:
        step = min(done, width - done)
        n = len(best) - step
        take = best[step:] < best[:n]
        best, at = np.where(take, best[step:], best[:n]), np.where(take, at[step:], at[:n])
        done += step
    return at
