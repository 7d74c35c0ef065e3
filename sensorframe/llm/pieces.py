"""SentencePiece encoding and decoding by suffix-array matching.

The distinct words of a batch are concatenated and their suffixes sorted; a binary search for every piece of
the vocabulary gives the range of suffixes that begin with it, hence all its occurrences.  Sorted by position
these are the edges of a graph over the text.  A byte-pair model relaxes it by merging, in every word, the
neighbouring pair whose edge has the best score (the leftmost of equal ones) until no pair has an edge; a
unigram model takes the best path.  Both give the ids of the reference library.

Words are cached within a task up to a fixed number, so a batch indexes only words it has not met.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

SPACE = "▁"
#: characters indexed at once, and words remembered by a task
INDEX_CHARS, CACHE_WORDS = 400_000, 250_000
#: longer words are merged by a heap instead of in step with the others
STEP_CHARS = 48
_END = 0x110000

# fixed values of the model format
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2


@dataclass
class PieceModel:
    """Vocabulary and flags of a model file with the identity normaliser."""

    pieces: list[str]
    kinds: list[int]
    scores: list[float]
    bpe: bool
    dummy_prefix: bool
    #: the model file's content for words that bring their own blank mark
    plain: bytes = b""

    @classmethod
    def load(cls, path: str) -> PieceModel:
        from sentencepiece import sentencepiece_model_pb2 as proto

        model = proto.ModelProto()
        with open(path, "rb") as file:
            model.ParseFromString(file.read())
        norm, kind = model.normalizer_spec, model.trainer_spec.model_type
        kinds = [p.type for p in model.pieces]
        if norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.escape_whitespaces:
            raise ValueError("only models without text normalisation are supported")
        if kind not in (UNIGRAM, BPE) or USER_DEFINED in kinds or model.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("model type or pieces not supported")
        prefix, norm.add_dummy_prefix = norm.add_dummy_prefix, False
        scores = [p.score for p in model.pieces]
        return cls([p.piece for p in model.pieces], kinds, scores, kind == BPE, prefix, model.SerializeToString())

    @cached_property
    def ids(self) -> np.ndarray:
        """Ids of the pieces that match text."""
        return np.array([i for i, k in enumerate(self.kinds) if k == NORMAL], np.int64)

    @cached_property
    def longest(self) -> int:
        return max((len(self.pieces[i]) for i in self.ids.tolist()), default=1)

    @cached_property
    def codes(self) -> tuple[np.ndarray, np.ndarray]:
        """Code points of the matching pieces (padded with 0) and their lengths."""
        size = np.array([len(self.pieces[i]) for i in self.ids.tolist()], np.int64)
        table = np.zeros((len(size), self.longest), np.uint32)
        for row, i in enumerate(self.ids.tolist()):
            table[row, : size[row]] = np.frombuffer(self.pieces[i].encode("utf-32-le"), np.uint32)
        return table, size

    @cached_property
    def priority(self) -> np.ndarray:
        """Order of merging by id: 0 first; equal scores share a number."""
        return np.unique(-np.array(self.scores, float), return_inverse=True)[1].astype(np.int64)

    @cached_property
    def byte_ids(self) -> list[int]:
        """Ids of the 256 bytes, or of the unknown piece if the model has no bytes."""
        named = {p: i for i, p in enumerate(self.pieces) if self.kinds[i] == BYTE}
        unknown = self.kinds.index(UNKNOWN) if UNKNOWN in self.kinds else 0
        return [named.get(f"<0x{b:02X}>", unknown) for b in range(256)]

    @cached_property
    def has_bytes(self) -> bool:
        return BYTE in self.kinds

    @cached_property
    def splitter(self) -> re.Pattern[str]:
        """Cuts a text where no piece can reach across: before blanks, and around line ends."""
        long = [self.pieces[i] for i in self.ids.tolist() if len(self.pieces[i]) > 1]
        if any(SPACE in p.lstrip(SPACE) for p in long):
            return re.compile(r"(?s).+")
        if any("\n" in p for p in long):
            return re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
        return re.compile(f"\n|{SPACE}*[^{SPACE}\n]+|{SPACE}+")

    @cached_property
    def raw(self) -> list[bytes]:
        """What every id decodes to, blanks still marked."""
        out = []
        for piece, kind in zip(self.pieces, self.kinds):
            if kind == BYTE:
                out.append(bytes([int(piece[3:5], 16)]))
            elif kind == UNKNOWN:
                out.append(" ⁇ ".encode())
            else:
                out.append(b"" if kind == CONTROL else piece.encode())
        return out


def packed(values: np.ndarray, bits: int, width: int) -> np.ndarray:
    """The next ``width`` values of every position in one number; past the end are zeros."""
    padded = np.concatenate((values, np.zeros(width, np.int64)))
    key = np.zeros(len(values), np.int64)
    for k in range(width):
        key = (key << bits) | padded[k : k + len(values)]
    return key


@dataclass
class SuffixArray:
    """Suffixes of ``codes`` sorted by their first ``depth`` values at least: packed prefixes, then doubling."""

    codes: np.ndarray
    depth: int

    def __post_init__(self) -> None:
        self.symbols, dense = np.unique(self.codes, return_inverse=True)
        self.bits = int(len(self.symbols)).bit_length()
        self.width = 63 // self.bits
        n = len(self.codes)
        key = prefix = packed(dense.astype(np.int64) + 1, self.bits, self.width)
        order, width = np.argsort(key), self.width
        while width < self.depth:
            rank = np.empty(n, np.int64)
            rank[order] = np.cumsum(np.concatenate(([1], np.diff(key[order]) != 0)))
            key = rank * (n + 1) + np.concatenate((rank[width:], np.zeros(min(width, n), np.int64)))[:n]
            order, width = np.argsort(key), 2 * width
        self.order, self.prefix = order, prefix[order]

    def ranges(self, table: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For every row of ``table`` (of ``size`` values) the range of suffixes that begin with it, by binary search.

        Rows that fit into a packed prefix search those; longer ones then search value by value inside the range
        of their beginning.
        """
        at = np.minimum(np.searchsorted(self.symbols, table), len(self.symbols) - 1)
        inside = np.arange(table.shape[1]) < size[:, None]
        known = ((self.symbols[at] == table) | ~inside).all(axis=1)
        dense = np.where(inside, at + 1, 0)
        key = np.zeros(len(table), np.int64)
        for k in range(self.width):
            key = (key << self.bits) | (dense[:, k] if k < table.shape[1] else 0)
        free = np.maximum(0, self.width - size) * self.bits
        low = np.searchsorted(self.prefix, key)
        high = np.searchsorted(self.prefix, key + (np.int64(1) << free))
        high = np.where(known, high, low)
        long = np.flatnonzero((size > self.width) & (low < high))
        if len(long):
            pieces, column = table[long].astype(np.int64), inside[long]
            low[long], high[long] = (self._bound(pieces, column, low[long], high[long], after) for after in (False, True))
        return low, high

    def _bound(self, pieces: np.ndarray, inside: np.ndarray, low: np.ndarray, high: np.ndarray, after: bool) -> np.ndarray:
        text = np.concatenate((self.codes.astype(np.int64), np.full(pieces.shape[1], -1)))
        column, low, high = np.arange(pieces.shape[1]), low.copy(), high.copy()
        while len(open_ := np.flatnonzero(low < high)):
            middle = (low[open_] + high[open_]) // 2
            differ = (text[self.order[middle][:, None] + column] - pieces[open_]) * inside[open_]
            sign = differ[np.arange(len(open_)), (differ != 0).argmax(axis=1)]
            right = sign <= 0 if after else sign < 0
            low[open_[right]] = middle[right] + 1
            high[open_[~right]] = middle[~right]
        return low


class Encoder:
    """Encodes words by their occurrences of pieces; remembers words it has encoded."""

    def __init__(self, model: PieceModel) -> None:
        self.model = model
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.flat, self.begin = np.empty(0, np.int32), np.zeros(1, np.int64)

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, and where each text begins."""
        model = self.model
        units = []
        for text in texts:
            body = (text or "").replace(" ", SPACE)
            units.append(model.splitter.findall(SPACE + body if body and model.dummy_prefix else body))
        met = set(chain.from_iterable(units))
        fresh = list(met - self.known.keys())
        if len(self.known) + len(fresh) > CACHE_WORDS:
            self._forget()
            fresh = list(met)
        self._learn(fresh)
        total = [len(row) for row in units]
        index = np.fromiter(map(self.known.__getitem__, chain.from_iterable(units)), np.int64, sum(total))
        size = self.begin[index + 1] - self.begin[index]
        ends = np.cumsum(size)
        ids = self.flat[np.repeat(self.begin[index] - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)]
        rows = np.concatenate(([0], np.cumsum(total)))
        return ids, np.concatenate(([0], ends))[rows]

    def _learn(self, words: list[str]) -> None:
        at = 0
        while at < len(words):
            stop, chars = at, 0
            while stop < len(words) and (stop == at or chars + len(words[stop]) < INDEX_CHARS):
                chars += len(words[stop]) + 1
                stop += 1
            ids, begin = self._graph(words[at:stop])
            self.known.update(zip(words[at:stop], range(len(self.begin) - 1, len(self.begin) - 1 + stop - at)))
            self.begin = np.concatenate((self.begin, begin[1:] + self.begin[-1]))
            self.flat = np.concatenate((self.flat, ids))
            at = stop

    def _graph(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        model = self.model
        size = np.array([len(w) for w in words], np.int64)
        start = np.cumsum(size + 1) - size - 1
        codes = np.full(int(size.sum() + len(words)), _END, np.uint32)
        word = np.repeat(np.arange(len(words)), size)
        at = np.arange(len(word)) + word  # every word is followed by an end mark
        codes[at] = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
        index = SuffixArray(codes, model.longest)
        order = index.order
        table, length = model.codes
        low, high = index.ranges(table, length)
        count = high - low
        piece = np.repeat(np.arange(len(count)), count)
        where = order[np.arange(len(piece)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(low, count)]
        by_position = np.argsort(where)
        piece, where = piece[by_position], where[by_position]
        edge = np.full((len(codes), model.longest), -1, np.int32)  # id of the edge that leaves a position with a length
        edge[where, length[piece] - 1] = model.ids[piece]
        relax = self._merge if model.bpe else self._best_path
        return self._emit(codes, edge, *relax(edge, start, size))

    def _merge(self, edge: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Symbols ``(word, position, length)`` after all merges."""
        done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for w in np.flatnonzero(size > STEP_CHARS).tolist():
            at, length = self._merge_long(edge, int(start[w]), int(size[w]))
            done.append((np.full(len(at), w), at, length))
        few = np.flatnonzero(size <= STEP_CHARS)
        word = np.repeat(few, size[few])
        at = np.arange(len(word)) + np.repeat(start[few] - np.cumsum(size[few]) + size[few], size[few])
        length = np.ones(len(word), np.int64)
        none = np.int64(1) << 40
        while len(word):
            rank = np.full(len(word), none)
            both = length[:-1] + length[1:]
            pair = np.flatnonzero((word[:-1] == word[1:]) & (both <= edge.shape[1]))
            found = edge[at[pair], both[pair] - 1]
            rank[pair[found >= 0]] = self.model.priority[found[found >= 0]]
            first = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
            best = np.minimum.reduceat(rank * (1 << 22) + np.arange(len(word)), first)
            over = np.repeat(best >= none << 22, np.diff(np.append(first, len(word))))
            if over.any():
                done.append((word[over], at[over], length[over]))
            merge = best[best < none << 22] & ((1 << 22) - 1)
            length[merge] += length[merge + 1]
            keep = ~over
            keep[merge + 1] = False
            word, at, length = word[keep], at[keep], length[keep]
        return tuple(np.concatenate(x) for x in zip(*done)) if done else (np.empty(0, np.int64),) * 3

    def _merge_long(self, edge: np.ndarray, start: int, size: int) -> tuple[np.ndarray, np.ndarray]:
        """The same merges for one word, with a heap of pairs."""
        length = [1] * size
        before, after = list(range(-1, size - 1)), list(range(1, size + 1))
        alive = [True] * size
        heap: list[tuple[int, int, int]] = []

        def push(i: int) -> None:
            j = after[i] if i >= 0 else size
            if i >= 0 and j < size and (both := length[i] + length[j]) <= edge.shape[1]:
                piece = int(edge[start + i, both - 1])
                if piece >= 0:
                    heapq.heappush(heap, (int(self.model.priority[piece]), i, both))

        for i in range(size):
            push(i)
        while heap:
            _, i, both = heapq.heappop(heap)
            if not alive[i] or after[i] >= size or length[i] + length[after[i]] != both:
                continue
            j = after[i]
            length[i], alive[j], after[i] = both, False, after[j]
            if after[j] < size:
                before[after[j]] = i
            push(before[i])
            push(i)
        at = np.flatnonzero(alive)
        return at + start, np.array(length)[at]

    def _best_path(self, edge: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Symbols of the path with the largest sum of scores; an unknown character costs ten below the worst."""
        scores = np.array(self.model.scores)
        unknown = float(scores[self.model.ids].min()) - 10
        out: list[tuple[int, int, int]] = []
        for w, (s, n) in enumerate(zip(start.tolist(), size.tolist())):
            best, back = [0.0] + [-np.inf] * n, [0] * (n + 1)
            for i in range(n):
                for k, piece in enumerate(edge[s + i, : n - i].tolist(), 1):
                    value = best[i] + (scores[piece] if piece >= 0 else unknown)
                    if (piece >= 0 or k == 1) and value > best[i + k]:
                        best[i + k], back[i + k] = value, k
            path, i = [], n
            while i:
                path.append((w, s + i - back[i], back[i]))
                i -= back[i]
            out += path[::-1]
        return tuple(np.array(x, np.int64) for x in zip(*out)) if out else (np.empty(0, np.int64),) * 3

    def _emit(self, codes: np.ndarray, edge: np.ndarray, word: np.ndarray, at: np.ndarray, length: np.ndarray):
        """Ids by word; symbols without a piece become bytes."""
        words = int((codes == _END).sum())
        order = np.argsort(at, kind="stable")
        word, at, length = word[order], at[order], length[order]
        ids = edge[at, length - 1].astype(np.int64) if len(at) else np.empty(0, np.int64)
        width = np.ones(len(ids), np.int64)
        missing = np.flatnonzero(ids < 0)
        spelled = {}
        for k in missing.tolist():
            raw = chr(codes[at[k]]).encode("utf-8", "surrogatepass")
            spelled[k] = [self.model.byte_ids[b] for b in raw] if self.model.has_bytes else self.model.byte_ids[:1]
            width[k] = len(spelled[k])
        ends = np.cumsum(width)
        out = np.repeat(ids, width)
        for k, found in spelled.items():
            out[ends[k] - width[k] : ends[k]] = found
        begin = np.concatenate(([0], ends))[np.searchsorted(word, np.arange(words + 1))]
        return out.astype(np.int32), begin



class LibraryEncoder(Encoder):
    """The same ids, with new words encoded by the reference library: for uses where encoding is not the point."""

    def __init__(self, model: PieceModel) -> None:
        from sentencepiece import SentencePieceProcessor

        super().__init__(model)
        self.processor = SentencePieceProcessor(model_proto=model.plain)

    def _graph(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = self.processor.encode(words, num_threads=1)
        ids = np.fromiter(chain.from_iterable(found), np.int32)
        return ids, np.concatenate(([0], np.cumsum([len(f) for f in found])))


def encoder(
    model: PieceModel, names: list[str], text_col: str = "text", out: str = "ids", batch_rows: int = 1000, library: bool = False
) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function for tasks that adds the ids ``out`` to batches with columns ``names``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = LibraryEncoder(model) if library else Encoder(model)
        for batch in batches:
            for k in range(0, batch.num_rows, batch_rows):
                piece = batch.slice(k, batch_rows)
                texts = piece.column(names.index(text_col)).to_pylist()
                ids, begin = own.encode(texts)
                lists = pa.ListArray.from_arrays(
                    pa.array(begin.astype(np.int32)), pa.array(ids), mask=pa.array([t is None for t in texts])
                )
                yield pa.RecordBatch.from_arrays([*piece.columns, lists], [*names, out])

    return run


def encode(
    docs: DataFrame,
    model: PieceModel,
    text_col: str = "text",
    out: str = "ids",
    batch_rows: int = 1000,
    library: bool = False,
) -> DataFrame:
    """Add ``out``, the piece ids of the text; all columns and rows stay (an existing ``out`` is replaced).

    A null text gives null, an empty one no ids.  Equal texts give equal ids.  With ``library`` new words are
    encoded by the reference library instead of the suffix array; the ids are the same.
    """
    docs = docs.drop(out) if out != text_col else docs
    schema = docs.select("*", F.lit(None).cast("array<int>").alias(out)).schema
    return docs.mapInArrow(encoder(model, docs.columns, text_col, out, batch_rows, library), schema)


def decode(rows: DataFrame, model: PieceModel, ids_col: str = "ids", out: str = "decoded") -> DataFrame:
    """Add ``out``, the text of ``ids_col``: the exact inverse of :func:`encode`.

    Null ids give null.  Bytes that are not UTF-8 become replacement characters; an id outside the
    vocabulary is an error.
    """
    rows = rows.drop(out) if out != ids_col else rows
    names = rows.columns
    prefix = model.dummy_prefix

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw = model.raw
        for batch in batches:
            texts = []
            for ids in batch.column(names.index(ids_col)):
                if not ids.is_valid:
                    texts.append(None)
                    continue
                found = ids.values.to_numpy(zero_copy_only=False).tolist()
                if found and min(found) < 0:
                    raise ValueError("negative id")
                body = b"".join([raw[i] for i in found]).decode("utf-8", "replace").replace(SPACE, " ")
                texts.append(body[1:] if prefix and body.startswith(" ") else body)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*names, out])

    return rows.mapInArrow(run, rows.select("*", F.lit(None).cast("string").alias(out)).schema)
