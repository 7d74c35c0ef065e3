"""Quality rules: lines are labelled content or boilerplate, and the share of content decides whether a document stays.

A document is the sequence of its lines that hold a word.  A linear-chain conditional random field gives a sequence of labels the
score ``sum_t w . x_t [label_t = boilerplate] + sum_t T[label_{t-1}, label_t]``; Viterbi decoding finds the best one.

The field is learned from labels of documents, on a sample of bounded size.  First all lines of a poor document count as boilerplate
and transitions are left out (Newton's method on the lines); lines of poor documents that look like those of good ones
then become content, and the whole field is fitted to these labels (BFGS on the exact likelihood, from forward-backward
sums).  Every step adds up gradients where the lines are; only sums come to the driver.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from sensorframe.llm.text import WordHasher, buffers, find_words, slices
from sensorframe.plans.sizing import store

#: labelled documents per class that the field is fitted on (about; picked by a hash of the id), and parts they are kept in
FIT_ROWS, SHARDS = 2000, 8
#: weight of the squared weights in the likelihood, steps of either fit
RIDGE, NEWTON, STEPS = 1.0, 8, 25
#: share of a document's words that must lie in content lines
SHARE = 0.5

SYMBOLS = b"#*$%&|<>"
FEATURES = (
    "one words short symbols symbols2 symbols8 calls calls30 capitals capitals50 digits repeats repeats50 copied windows bars "
    "sentence length long"
).split()


def _lookup(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


_symbol, _digit, _upper = _lookup(SYMBOLS), _lookup(b"0123456789"), _lookup(bytes(range(65, 91)))
_letter = _lookup(bytes([*range(65, 91), *range(97, 123)]))
_call, _bar, _stop, _first_byte = _lookup(b"!"), _lookup(b"|"), _lookup(b".!?:;\"'"), np.ones(256, bool)
_first_byte[0x80:0xC0] = False
_HASH, _CHECK = WordHasher(31), WordHasher(32)


def _sums(flags: np.ndarray) -> np.ndarray:
    return np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))


def _word_ids(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Equal numbers for equal words."""
    _, first, ids = np.unique(_HASH(data, start, end), return_index=True, return_inverse=True)
    check = _CHECK(data, start, end)
    if (check[first][ids] == check).all() and (end - start == (end - start)[first][ids]).all():
        return ids
    raw, known = data.tobytes(), {}  # two words share a hash
    return np.array([known.setdefault(raw[a:b], len(known)) for a, b in zip(start, end)], np.int64)


def _numbered(*columns: np.ndarray) -> np.ndarray:
    """Equal numbers for equal rows."""
    out = columns[0]
    for c in columns[1:]:
        out = np.unique(out.astype(np.uint64) * np.uint64(int(c.max(initial=0)) + 1) + c.astype(np.uint64), return_inverse=True)[1]
    return out


@dataclass
class Measures:
    """Counts per text, and the lines with words: their text, place (bytes), number of words and features."""

    counts: dict[str, np.ndarray]
    row: np.ndarray
    start: np.ndarray
    end: np.ndarray
    words: np.ndarray
    features: np.ndarray
    #: code points before every byte
    points: np.ndarray


def measure(data: np.ndarray, offsets: np.ndarray) -> Measures:
    """Measures of the texts that lie between ``offsets`` of ``data``."""
    n = len(offsets) - 1
    start, end, first = find_words(data, offsets)
    text_of = np.repeat(np.arange(n), np.diff(first))
    points, symbols = _sums(_first_byte[data]), _sums(_symbol[data])
    chars = _sums(points[end] - points[start])
    ids = _word_ids(data, start, end)

    repeated = np.zeros(len(ids) + 1, np.int64)
    inner = np.flatnonzero(text_of[2:] == text_of[:-2]) if len(ids) > 2 else np.empty(0, np.int64)
    if len(inner):
        window = _numbered(ids[inner], ids[inner + 1], ids[inner + 2], text_of[inner])
        twice = inner[np.bincount(window)[window] > 1]
        np.add.at(repeated, twice, 1)
        repeated[: len(ids)] = repeated[:-1] + np.concatenate(([0], repeated[:-2])) + np.concatenate(([0, 0], repeated[:-3]))
    covered = _sums(repeated[: len(ids)] > 0)

    newline = np.flatnonzero(data == 10)
    begin = np.sort(np.concatenate((offsets[:-1], newline + 1)))
    row = np.searchsorted(offsets, np.sort(np.concatenate((offsets[:-1], newline))), "right") - 1
    row = np.minimum(row, n - 1)
    # a text that starts where another ends: lines are told apart by their text, empty ones hold no word
    stop = np.minimum(np.concatenate((begin[1:], [len(data)])), offsets[row + 1]) if n else begin
    ends_in_break = np.zeros(len(begin), bool)
    inside = stop > begin
    ends_in_break[inside] = data[stop[inside] - 1] == 10
    stop = stop - ends_in_break
    low, high = np.searchsorted(start, begin), np.searchsorted(start, stop)
    full = high > low
    row, begin, stop, low, high = row[full], begin[full], stop[full], low[full], high[full]

    raw, copied, at, seen = data.tobytes(), np.zeros(len(row), bool), -1, set()
    for k, (r, a, b) in enumerate(zip(row.tolist(), begin.tolist(), stop.tolist())):
        if r != at:
            at, seen = r, set()
        line = raw[a:b]
        if line in seen:
            copied[k] = True
        seen.add(line)

    def per_line(flags: np.ndarray) -> np.ndarray:
        total = _sums(flags[data])
        return total[stop] - total[begin]

    words = high - low
    line_of = np.repeat(np.arange(len(row)), words)
    pair = np.unique(line_of.astype(np.uint64) << np.uint64(32) | ids.astype(np.uint64))
    distinct = np.bincount((pair >> np.uint64(32)).astype(np.int64), minlength=len(row))
    size = chars[high] - chars[low]
    signs, calls = (symbols[stop] - symbols[begin]) / size, per_line(_call) / words
    capitals = per_line(_upper) / np.maximum(per_line(_letter), 1)
    again, length = 1 - distinct / words, size / words
    features = [
        np.ones(len(row)), np.log1p(words) / 5, words < 4, signs, signs > 0.02, signs > 0.08, calls, calls > 0.3, capitals, capitals > 0.5,
        per_line(_digit) / size, again, again > 0.5, copied, (covered[high] - covered[low]) / words, per_line(_bar) / words,
        _stop[data[end[high - 1] - 1]] if len(row) else row, length / 10, length > 12,
    ]
    counts = {
        "n_words": np.diff(first),
        "word_chars": np.diff(chars[first]),
        "n_symbols": np.diff(symbols[offsets]),
        "n_dup_lines": np.bincount(row[copied], minlength=n),
        "n_repeat_words": np.diff(covered[first]),
    }
    return Measures(counts, row, begin, stop, words, np.stack([f.astype(np.float64) for f in features], axis=1), points)


@dataclass
class Field:
    """Weights of boilerplate over content, and of the four transitions (content is 0, boilerplate 1)."""

    weights: np.ndarray
    moves: np.ndarray

    def decode(self, features: np.ndarray, row: np.ndarray) -> np.ndarray:
        """The best label of every line; a tie is content."""
        score = (features @ self.weights).tolist()
        (cc, cb), (bc, bb) = self.moves.tolist()
        back, last, c, b = [], -1, 0.0, 0.0
        for s, r in zip(score, row.tolist()):
            if r != last:
                last, c, b = r, 0.0, s
                back.append((-1, -1))
            else:
                from_c, from_b = (0 if c + cc >= b + bc else 1), (0 if c + cb >= b + bb else 1)
                c, b = (b + bc if from_c else c + cc), (b + bb if from_b else c + cb) + s
                back.append((from_c, from_b))
            back.append((c, b))
        labels, label, ended = np.zeros(len(score), np.int8), 0, True
        for t in range(len(score) - 1, -1, -1):
            before, (c, b) = back[2 * t], back[2 * t + 1]
            if ended:
                label = 1 if b > c else 0
            labels[t] = label
            ended = before[0] < 0
            if not ended:
                label = before[label]
        return labels


def _softplus(x: float) -> float:
    return max(x, 0.0) + math.log1p(math.exp(-abs(x)))


def _together(x: float, y: float) -> float:
    return y + _softplus(x - y)


def likelihood(features: np.ndarray, labels: np.ndarray, weights: np.ndarray, moves: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Log-likelihood of one sequence's labels and its gradients, by forward and backward sums."""
    score, n = (features @ weights).tolist(), len(labels)
    (cc, cb), (bc, bb) = moves.tolist()
    ahead = [(0.0, score[0])]
    for s in score[1:]:
        c, b = ahead[-1]
        ahead.append((_together(c + cc, b + bc), _together(c + cb, b + bb) + s))
    total = _together(*ahead[-1])
    after, bad, pairs = (0.0, 0.0), [0.0] * n, [0.0] * 4
    for t in range(n - 1, -1, -1):
        c, b = ahead[t]
        bad[t] = math.exp(b + after[1] - total)
        if t:
            c, b = ahead[t - 1]
            to_b = after[1] + score[t]
            for k, v in enumerate((c + cc + after[0], c + cb + to_b, b + bc + after[0], b + bb + to_b)):
                pairs[k] += math.exp(v - total)
            after = (_together(cc + after[0], cb + to_b), _together(bc + after[0], bb + to_b))
    seen = np.bincount(2 * labels[:-1].astype(int) + labels[1:], minlength=4).reshape(2, 2)
    value = float(np.dot(score, labels)) + float((seen * moves).sum()) - total
    return value, (labels - np.array(bad)) @ features, seen - np.array(pairs).reshape(2, 2)


def _sequences(batch: pa.RecordBatch) -> Iterator[tuple[bool, np.ndarray]]:
    for poor, flat in zip(batch.column("poor").to_pylist(), batch.column("features")):
        yield poor, np.asarray(flat.values, np.float64).reshape(-1, len(FEATURES))


def _summed(sample: DataFrame, per_document: Callable[[bool, np.ndarray], np.ndarray]) -> np.ndarray:
    """Sum over the sample's documents; one row a part comes to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: np.ndarray | float = 0.0
        for batch in batches:
            for poor, x in _sequences(batch):
                total = total + per_document(poor, x)
        if isinstance(total, np.ndarray):
            yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64()))], ["v"])

    return np.sum([r["v"] for r in sample.mapInArrow(run, "v array<double>").collect()], axis=0)


def _newton(sample: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Weights of a logistic regression of lines on their document's class, and its Hessian."""
    k = len(FEATURES)
    weights, hessian = np.zeros(k), np.eye(k)
    for _ in range(NEWTON):

        def part(poor: bool, x: np.ndarray, w: np.ndarray = weights) -> np.ndarray:
            p = 1 / (1 + np.exp(-np.clip(x @ w, -500, 500)))
            return np.concatenate(((float(poor) - p) @ x, ((x * (p * (1 - p))[:, None]).T @ x).ravel()))

        sums = _summed(sample, part)
        hessian = sums[k:].reshape(k, k) + RIDGE * np.eye(k)
        step = np.linalg.solve(hessian, sums[:k] - RIDGE * weights)
        step *= min(1.0, 5.0 / max(float(np.abs(step).max()), 1e-9))
        weights = weights + step
        if np.abs(step).max() < 1e-3:
            break
    return weights, hessian


def _bfgs(sample: DataFrame, rough: np.ndarray, hessian: np.ndarray) -> Field:
    """The field that fits the lines of good documents, and those of poor ones that ``rough`` does not take for good."""
    k = len(rough)

    def value(at: np.ndarray) -> tuple[float, np.ndarray]:
        def part(poor: bool, x: np.ndarray) -> np.ndarray:
            labels = (x @ rough > 0).astype(np.int8) if poor else np.zeros(len(x), np.int8)
            like, w, m = likelihood(x, labels, at[:k], at[k:].reshape(2, 2))
            return np.concatenate(([like], w, m.ravel()))

        sums = _summed(sample, part)
        return RIDGE / 2 * float(at @ at) - sums[0], RIDGE * at - sums[1:]

    at, inverse = np.concatenate((rough, np.zeros(4))), np.eye(k + 4) / 100
    inverse[:k, :k] = np.linalg.inv(hessian)
    cost, slope = value(at)
    for _ in range(STEPS):
        step, length = -inverse @ slope, 1.0
        step *= min(1.0, 5.0 / max(float(np.abs(step).max()), 1e-9))
        while length > 1e-3:
            new_cost, new_slope = value(at + length * step)
            if new_cost <= cost + 1e-4 * length * float(slope @ step):
                break
            length /= 4
        else:
            break
        moved, turned = length * step, new_slope - slope
        done = cost - new_cost < 1e-6 * abs(cost)
        at, cost, slope = at + moved, new_cost, new_slope
        if done:
            break
        if (along := float(moved @ turned)) > 1e-12:
            left = np.eye(k + 4) - np.outer(moved, turned) / along
            inverse = left @ inverse @ left.T + np.outer(moved, moved) / along
    return Field(at[:k], at[k:].reshape(2, 2))


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = buffers(batch.column("_text"))
        for a, b in slices(offsets):
            found = measure(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            begin = np.searchsorted(found.row, np.arange(b - a + 1)) * len(FEATURES)
            flat = pa.array(found.features.ravel(), pa.float64())
            lists = pa.ListArray.from_arrays(pa.array(begin, pa.int32()), flat)
            yield pa.RecordBatch.from_arrays([batch.column("poor").slice(a, b - a), lists], ["poor", "features"])


def fit(docs: DataFrame, labels: DataFrame, good: Column, id_col: str = "doc_id", text_col: str = "text", fit_rows: int = FIT_ROWS) -> Field | None:
    """The field learned from about ``fit_rows`` good and as many poor documents; None if either kind has no line.

    ``labels`` has ``id_col`` and what ``good`` is made of; null ids and null classes are not used, and an id with both classes
    counts in both.
    """
    known = labels.select(F.col(id_col).alias("_id"), (~good).alias("poor")).filter("_id IS NOT NULL AND poor IS NOT NULL").distinct()
    n = {r["poor"]: r["count"] for r in known.groupBy("poor").count().collect()}
    if len(n) < 2:
        return None
    share = F.when(F.col("poor"), fit_rows / n[True]).otherwise(fit_rows / n[False])
    draw = F.pmod(F.xxhash64(F.lit("lines"), "_id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    picked = store(known.filter(draw < share))
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(F.broadcast(picked), "_id")
    lined = texts.select("poor", "_text").mapInArrow(_featured, "poor boolean, features array<double>")
    sample = store(lined.filter(F.size("features") > 0).repartition(SHARDS))
    if sample.select("poor").distinct().count() < 2:
        return None
    return _bfgs(sample, *_newton(sample))


def _judged(field: Field | None, share: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = buffers(batch.column("_text"))
            rest = [c for c in batch.schema.names if c != "_text"]
            for a, b in slices(offsets):
                found = measure(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                n, start = b - a, (offsets[a : b + 1] - offsets[a])[:-1]
                bad = field.decode(found.features, found.row) == 1 if field else np.zeros(len(found.row), bool)
                content = np.bincount(found.row[~bad], found.words[~bad], n).astype(np.int64)
                row, base = found.row[bad], found.points[start]
                spans = pa.StructArray.from_arrays(
                    [pa.array(found.points[x[bad]] - base[row], pa.int64()) for x in (found.start, found.end)], ["start", "end"]
                )
                lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(n + 1)), pa.int32()), spans)
                counts = [pa.array(c, pa.int64()) for c in found.counts.values()]
                stays = pa.array(content >= share * found.counts["n_words"])
                columns = [*[batch.column(c).slice(a, n) for c in rest], *counts, pa.array(content), lists, stays]
                yield pa.RecordBatch.from_arrays(columns, [*rest, *found.counts, "content_words", "boilerplate", "mostly_content"])

    return run


def judge(docs: DataFrame, field: Field | None, id_cols: list[str], text_col: str = "text", share: float = SHARE) -> DataFrame:
    """``id_cols``, counts, and what the field finds, for every row.

    ``n_words``, ``word_chars`` (code points in words), ``n_symbols``, ``n_dup_lines`` (lines with a word that equal an earlier one) and
    ``n_repeat_words`` (words in 3-word windows found twice or more in the text) are plain counts.  ``boilerplate`` holds the places
    (code points, end exclusive) of the lines so labelled, ``content_words`` the words of the others, and
    ``mostly_content`` says whether these are at least ``share`` of all.

    A null or empty text, or one without words, has no lines and counts as content; without a field every line is content, and so
    are ties.  Texts are measured whole; a very long one is measured alone, in memory in proportion to its size, and
    decoding takes one pass over its lines.  Repeated rows are each judged, an empty table gives no rows, other columns are not read.
    """
    renamed = [F.col(c).alias(f"_id{i}") for i, c in enumerate(id_cols)]
    kept = ", ".join(f"`_id{i}` {docs.select(c).dtypes[0][1]}" for i, c in enumerate(id_cols))
    counts = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, content_words long"
    schema = f"{kept}, {counts}, boilerplate array<struct<start:long,end:long>>, mostly_content boolean"
    found = docs.select(*renamed, F.col(text_col).alias("_text")).mapInArrow(_judged(field, share), schema)
    return found.withColumnsRenamed({f"_id{i}": c for i, c in enumerate(id_cols)})
