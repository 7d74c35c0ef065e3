"""Secret scanning: fixed patterns, and a battery of randomness tests on every long token.

A token of 20 or more letters, digits and ``+ / _ -`` is given the smallest encoding that holds
its characters.  Under the hypothesis "random characters of that encoding" three statistics are
turned into p-values: the chi-squared statistic of the symbol counts (with its exact mean and variance
under short lengths) and of the character classes, the runs above and below the middle of the alphabet,
and the serial correlation of neighbouring symbols.  The least of them, corrected for their number, is
uniform for random tokens and close to 0 for words.

A token that the battery does not reject is weighed against words: how much likelier are its characters if drawn from its
encoding than by a fixed model of words, names, paths and numbers (changes of character class, letter frequencies)?  This ratio
is an e-value of "this is a word", so the step-up rule for e-values over all tokens keeps the expected share of words among the
reported at ``rate`` as far as the model holds: ``reported`` of ``all`` tokens have a ratio of at least ``all / (rate * reported)``.
A lone token needs a ratio of ``all / rate`` and no other random token beside it.
"""

from __future__ import annotations

import hashlib
import math
import re
import string
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from sensorframe.plans.sizing import store

KINDS = ("assign", "access", "hex", "random")

# fixed patterns
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
TOKEN = re.compile(r"[A-Za-z0-9+/_-]{20,}")

_KEYWORDS = ("passw", "secret", "token", "api")
ENCODINGS = {
    "dec": string.digits,
    "hex": string.digits + "abcdef",
    "HEX": string.digits + "ABCDEF",
    "base32": string.ascii_uppercase + "234567",
    "base36": string.digits + string.ascii_lowercase,
    "BASE36": string.digits + string.ascii_uppercase,
    "base62": string.digits + string.ascii_uppercase + string.ascii_lowercase,
    "base64": string.ascii_uppercase + string.ascii_lowercase + string.digits + "+/",
    "base64url": string.ascii_uppercase + string.ascii_lowercase + string.digits + "-_",
    "mixed": string.ascii_uppercase + string.ascii_lowercase + string.digits + "+/-_",
}
_VALUE = {name: {c: i for i, c in enumerate(alphabet)} for name, alphabet in ENCODINGS.items()}
_SETS = {name: frozenset(alphabet) for name, alphabet in ENCODINGS.items()}
_CLASSES = (string.digits, string.ascii_uppercase, string.ascii_lowercase, "+/-_")
_SHARE = {n: [sum(c in cls for c in alphabet) / len(alphabet) for cls in _CLASSES] for n, alphabet in ENCODINGS.items()}
#: of words: share of each class at the start, and after each class
_START = (0.05, 0.25, 0.65, 0.05)
_AFTER = ((0.60, 0.10, 0.10, 0.20), (0.04, 0.45, 0.46, 0.05), (0.02, 0.04, 0.89, 0.05), (0.15, 0.25, 0.55, 0.05))
_LETTERS = dict(zip("eainsrtoldumhcpgbfvwkyzjqx", (14, 8, 7.5, 7.5, 7, 6.8, 6.8, 6, 4.6, 4.2, 4.2, 2.8, 3, 3.2, 2.2, 2, 1.5, 1.3, 1.2, 1, 0.9, 0.8, 0.7, 0.3, 0.3, 0.3)))
_CLASS = {c: i for i, cls in enumerate(_CLASSES) for c in cls}
#: bits of each character within its class: digits and signs alike, letters by frequency
_BITS = {c: math.log2(len(_CLASSES[i])) for c, i in _CLASS.items()}
for _c, _n in _LETTERS.items():
    _BITS[_c] = _BITS[_c.upper()] = -math.log2(0.9 * _n / sum(_LETTERS.values()) + 0.1 / 26)
#: p-value under which a token has a pattern and is not random; largest ratio told apart, in bits
LEVEL, MOST = 0.001, 255
#: share of words tolerated among reported tokens
RATE = 0.05


def _upper(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def infer(token: str) -> str:
    """The first (smallest) encoding that holds every character."""
    found = set(token)
    return next(name for name, alphabet in _SETS.items() if found <= alphabet)


def battery(token: str) -> tuple[str, float]:
    """Encoding and p-value of "these are random characters of that encoding"."""
    name = infer(token)
    k, n = len(ENCODINGS[name]), len(token)
    value = np.array([_VALUE[name][c] for c in token], float)
    counts = np.bincount(value.astype(int), minlength=k)
    chi = float((counts * counts).sum()) * k / n - n
    tests = [_upper((chi - (k - 1)) / math.sqrt(2 * (k - 1) * (n - 1) / n))]
    classes = [(sum(map(token.count, cls)), n * share) for cls, share in zip(_CLASSES, _SHARE[name]) if share]
    if len(classes) > 1:
        excess = sum((seen - want) ** 2 / want for seen, want in classes)
        free = len(classes) - 1  # Wilson and Hilferty's normal approximation
        tests.append(_upper(((excess / free) ** (1 / 3) - 1 + 2 / (9 * free)) / math.sqrt(2 / (9 * free))))
    high = value >= k / 2
    above = int(high.sum())
    below = n - above
    if above and below:
        runs = 1 + int((high[1:] != high[:-1]).sum())
        mean = 2 * above * below / n + 1
        deviation = math.sqrt(max((mean - 1) * (mean - 2) / (n - 1), 1e-9))
        tests.append(2 * _upper(abs(runs - mean) / deviation))
    else:
        tests.append(2.0 ** (1 - n))
    centred = value - value.mean()
    power = float(centred @ centred)
    serial = float(centred[1:] @ centred[:-1]) / power if power else 1.0
    tests.append(2 * _upper(abs(serial + 1 / n) * math.sqrt(n)))
    least = min(1.0, max(0.0, min(tests)))
    return name, -math.expm1(len(tests) * math.log1p(-least)) if least < 1 else 1.0


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """``(start, end, kind)`` of the fixed patterns, in code points, by start and kind."""
    found = []
    low = text.lower()
    if any(word in low for word in _KEYWORDS):
        found += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    found += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


def evidence(token: str, name: str) -> float:
    """Bits by which random characters of encoding ``name`` explain the token better than the model of words does.

    The encoding was picked by looking at the token, which its number of rivals pays for.
    """
    classes = [_CLASS[c] for c in token]
    words = -math.log2(_START[classes[0]]) + sum(map(_BITS.__getitem__, token))
    words -= sum(math.log2(_AFTER[x][y]) for x, y in zip(classes, classes[1:]))
    return words - len(token) * math.log2(len(ENCODINGS[name])) - math.log2(len(ENCODINGS))


def weigh(token: str) -> int:
    """Whole bits of evidence up to ``MOST``; -1 for words and for tokens with a pattern."""
    name, p = battery(token)
    return max(-1, min(MOST, math.floor(evidence(token, name)))) if p >= LEVEL else -1


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for text in batch.column("_text"):
            text = text.as_py() or ""
            base = base_spans(text)
            tokens, k, reach = [], 0, 0
            for m in TOKEN.finditer(text):  # both lists ascend: reach is the furthest end of spans that start before the token's end
                while k < len(base) and base[k][0] < m.end():
                    reach, k = max(reach, base[k][1]), k + 1
                if reach <= m.start():
                    tokens.append((m.start(), m.end(), weigh(m[0])))
            rows.append(([(a, b, k) for a, b, k in base], tokens))
        base, tokens = zip(*rows) if rows else ((), ())
        columns = [
            pa.array([[dict(zip(("a", "b", "kind"), s)) for s in x] for x in base], _BASE),
            pa.array([[dict(zip(("a", "b", "bits"), s)) for s in x] for x in tokens], _TOKENS),
        ]
        rest = [c for c in batch.schema.names if c != "_text"]
        yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in rest], *columns], [*rest, "base", "tokens"])


_BASE = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64()), ("kind", pa.string())]))
_TOKENS = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64()), ("bits", pa.int32())]))
_SCHEMA = "base array<struct<a:long,b:long,kind:string>>, tokens array<struct<a:long,b:long,bits:int>>"


def threshold(counts: dict[int, int], rate: float = RATE) -> int:
    """The fewest bits to report, from the number of tokens by bits; ``MOST + 1`` if none."""
    total, reported, least = sum(counts.values()), 0, MOST + 1
    for bits in range(MOST, -1, -1):
        reported += counts.get(bits, 0)
        if reported and reported * rate * 2.0**bits >= total:
            least = bits
    return least


def scan(docs: DataFrame, id_cols: list[str], text_col: str = "text", rate: float = RATE) -> DataFrame:
    """``id_cols`` and ``spans`` (array of ``start, end, kind`` in code points, by start and kind) per row.

    Fixed patterns are always reported; tokens that touch none of them are reported as ``random`` if
    they are no words.  A null or empty text has no spans; repeated rows are each scanned;
    other columns are not read.
    """
    renamed = [F.col(c).alias(f"_id{i}") for i, c in enumerate(id_cols)]
    narrow = docs.select(*renamed, F.col(text_col).alias("_text"))
    kept = ", ".join(f"`_id{i}` {docs.select(c).dtypes[0][1]}" for i, c in enumerate(id_cols))
    found = store(narrow.mapInArrow(_scan, f"{kept}, {_SCHEMA}"))
    counted = found.select(F.explode("tokens").alias("t")).groupBy("t.bits").count().collect()
    least = threshold({r["bits"]: r["count"] for r in counted}, rate)

    def span(t: Column, kind: Column) -> Column:
        rank = F.array_position(F.lit(list(KINDS)), kind).cast("int")
        return F.struct(t["a"].alias("start"), rank.alias("rank"), t["b"].alias("end"), kind.alias("kind"))

    base = F.transform("base", lambda t: span(t, t["kind"]))
    extra = F.transform(F.filter("tokens", lambda t: t["bits"] >= least), lambda t: span(t, F.lit("random")))
    spans = F.transform(
        F.array_sort(F.concat(base, extra)), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))
    )
    return found.select(*[F.col(f"_id{i}").alias(c) for i, c in enumerate(id_cols)], spans.alias("spans"))


def written(spans: Column) -> Column:
    """``kind:start:end`` of spans, joined by commas."""
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","
    )


def redact(docs: DataFrame, text_col: str = "text", rate: float = RATE, mark: str = "[secret]") -> DataFrame:
    """``docs`` with every reported span of the text replaced by ``mark``; overlapping spans become one.

    All columns and rows stay; a null text stays null.
    """
    columns = docs.columns
    others = F.struct(F.lit(0).alias("_"), *[F.col(f"`{c}`") for c in columns if c != text_col])
    found = scan(docs.select(others.alias("_row"), F.col(text_col).alias("_t")), ["_row", "_t"], "_t", rate)

    @F.pandas_udf("string")
    def cut(texts: pd.Series, spans: pd.Series) -> pd.Series:
        out = []
        for text, found in zip(texts, spans):
            if text is not None and len(found):
                parts, at = [], 0
                for s in sorted(found, key=lambda s: s["start"]):
                    if s["start"] >= at:
                        parts += [text[at : s["start"]], mark]
                    at = max(at, s["end"])
                text = "".join(parts) + text[at:]
            out.append(text)
        return pd.Series(out, dtype=object)

    body = F.when(F.size("spans") > 0, cut("_t", "spans")).otherwise(F.col("_t"))
    return found.select(*[body.alias(c) if c == text_col else F.col(f"_row.`{c}`").alias(c) for c in columns])
