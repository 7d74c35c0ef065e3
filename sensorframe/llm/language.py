"""Language identification: multinomial logistic regression on TF-IDF character n-grams.

Features are hashed n-grams of letters (other characters become one blank); document
frequencies are counted over all learnable documents.  Weights come from follow-the-regularised-leader
with elastic-net penalties, online inside a few fixed shards of a bounded labelled sample whose states
are averaged after each epoch.  A temperature fitted on other labelled documents calibrates the scores.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from sensorframe.llm import text as tx
from sensorframe.plans.sizing import store

UNKNOWN = "und"
#: hashed n-gram buckets
BUCKETS = 1 << 14
GRAMS = (1, 2, 3)
#: labelled documents used for the weights, and for the temperature, per language (about; picked by a hash of id and text)
FIT_ROWS, CALIBRATION_ROWS = 1500, 500
SHARDS, EPOCHS = 4, 3
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.02, 0.1
#: an n-gram is strange to a model if fewer documents than this share hold it
RARE = 0.01

_letters: list[np.ndarray] = []


def _letter_table() -> np.ndarray:
    if not _letters:
        _letters.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _letters[0]


def grams(text: str) -> np.ndarray | None:
    """Buckets of all n-grams of a text, or nothing if it holds no letter."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letter_table()[points]
    if not letter.any():
        return None
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    points = np.where(letter, points, 32)[keep].astype(np.uint64)
    points = np.concatenate((np.array([32], tx.U), points, np.array([32], tx.U)))
    out = []
    for n in GRAMS:
        hashed = np.full(max(0, len(points) - n + 1), n, tx.U)
        for k in range(n):
            hashed = hashed * tx.U(0x100000001B3) + points[k : k + len(hashed)]
        out.append((hashed * tx.U(0x9E3779B97F4A7C15)) >> tx.U(64 - BUCKETS.bit_length() + 1))
    return np.concatenate(out).astype(np.int64)


def _counts(text: str) -> np.ndarray | None:
    found = grams(text)
    return None if found is None else np.bincount(found, minlength=BUCKETS)


def vector(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Length-one TF-IDF vector with damped term frequencies."""
    x = np.log1p(counts) * idf
    return x / max(float(np.sqrt(x @ x)), 1e-12)


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total, rows = np.zeros(BUCKETS, np.int64), 0
    for batch in batches:
        for text in batch.column("text"):
            counts = _counts(text.as_py())
            if counts is not None:
                total += counts > 0
                rows += 1
    if rows:
        total = np.append(total, rows)  # one bucket more: the documents
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], ["bucket", "df"])


def document_frequencies(docs: DataFrame) -> np.ndarray:
    """Inverse document frequencies over all rows of ``docs(text)``; ``BUCKETS`` sums reach the driver."""
    counted = docs.mapInArrow(_frequencies, "bucket int, df long").groupBy("bucket").agg(F.sum("df").alias("df"))
    df = np.zeros(BUCKETS + 1)
    for row in counted.collect():
        df[row["bucket"]] = row["df"]
    return np.log((1 + df[BUCKETS]) / (1 + df[:BUCKETS])) + 1


@dataclass
class Leader:
    """State of the follow-the-regularised-leader learner."""

    z: np.ndarray
    n: np.ndarray
    alpha: float = ALPHA
    beta: float = BETA
    l1: float = L1
    l2: float = L2

    def weights(self, rows: np.ndarray | slice = slice(None)) -> np.ndarray:
        z, n = self.z[rows], self.n[rows]
        rate = (self.beta + np.sqrt(n)) / self.alpha + self.l2
        return np.where(np.abs(z) <= self.l1, 0.0, -(z - np.sign(z) * self.l1) / rate)

    def learn(self, rows: np.ndarray, x: np.ndarray, label: int) -> None:
        w = self.weights(rows)
        score = x @ w
        p = np.exp(score - score.max())
        p /= p.sum()
        p[label] -= 1
        g = np.outer(x, p)
        step = (np.sqrt(self.n[rows] + g * g) - np.sqrt(self.n[rows])) / self.alpha
        self.z[rows] += g - step * w
        self.n[rows] += g * g


def _vectors(idf: np.ndarray):
    """Sparse feature rows of a labelled sample."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, x, names = [], [], []
            for text, *row in zip(batch.column("text").to_pylist(), *(batch.column(c).to_pylist() for c in ("lang", "draw", "shard"))):
                counts = _counts(text)
                if counts is not None:
                    full = vector(counts, idf)
                    some = np.flatnonzero(full)
                    at.append(some.astype(np.int32).tobytes())
                    x.append(full[some].astype(np.float32).tobytes())
                    names.append(row)
            columns = list(zip(*names)) or [(), (), ()]
            types = (pa.string(), pa.float64(), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [pa.array(at, pa.binary()), pa.array(x, pa.binary()), *[pa.array(c, t) for c, t in zip(columns, types)]],
                ["at", "x", "lang", "draw", "shard"],
            )

    return run


def _epoch(z: np.ndarray, n: np.ndarray, index: dict[str, int]):
    def run(table: pa.Table) -> pa.Table:
        leader = Leader(z.copy(), n.copy())
        for row in table.sort_by("draw").to_pylist():
            leader.learn(np.frombuffer(row["at"], np.int32), np.frombuffer(row["x"], np.float32).astype(float), index[row["lang"]])
        return pa.table({"z": [leader.z.tobytes()], "n": [leader.n.tobytes()]})

    return run


def _logits(weights: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [
                (np.frombuffer(x, np.float32) @ weights[np.frombuffer(at, np.int32)]).tolist()
                for at, x in zip(batch.column("at").to_pylist(), batch.column("x").to_pylist())
            ]
            yield pa.RecordBatch.from_arrays([pa.array(scores, pa.list_(pa.float64())), batch.column("lang")], ["s", "lang"])

    return run


def temperature(scored: DataFrame, languages: list[str]) -> float:
    """The temperature on a logarithmic grid with the least total log loss over ``(s, lang)``.

    One label's worth of mass is spread over all languages, so a sample without errors gives no infinite confidence.
    """
    smooth = 1.0 / (scored.count() + 1)
    grid = [float(t) for t in np.geomspace(0.02, 20, 70)]
    named = F.element_at("s", F.array_position(F.lit(languages), F.col("lang")).cast("int"))
    mean = F.aggregate("s", F.lit(0.0), lambda total, v: total + v) / F.lit(float(len(languages)))
    right = named * F.lit(1.0 - smooth) + mean * F.lit(smooth)
    top = F.array_max("s")

    def loss(t: float) -> Column:
        spread = F.aggregate("s", F.lit(0.0), lambda total, v: total + F.exp((v - top) / F.lit(t)))
        return F.sum(F.log(spread) - (right - top) / F.lit(t))

    losses = [loss(t).alias(f"t{i}") for i, t in enumerate(grid)]
    found = scored.agg(*losses).first()
    return min(((loss, t) for loss, t in zip(found, grid) if loss is not None), default=(0.0, 1.0))[1]


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray = field(default_factory=lambda: np.ones(BUCKETS))
    weights: np.ndarray = field(default_factory=lambda: np.zeros((BUCKETS, 0)))
    temperature: float = 1.0


def fit(labelled: DataFrame, fit_rows: int = FIT_ROWS, calibration_rows: int = CALIBRATION_ROWS, epochs: int = EPOCHS) -> Model:
    """Learn from ``labelled(id, text, lang)``.

    Rows without text, letters or language teach nothing.  Document frequencies use all rows; weights and
    temperature use about ``fit_rows`` and ``calibration_rows`` documents of every language, so what the
    fit reads is bounded.  Without any labelled text the model knows no language.
    """
    labelled = labelled.filter("text IS NOT NULL AND lang IS NOT NULL")
    counts = {r["lang"]: r["count"] for r in labelled.groupBy("lang").count().collect()}
    languages = sorted(counts)
    if not languages:
        return Model([])
    idf = document_frequencies(labelled.select("text"))
    draw = F.pmod(F.xxhash64(F.lit(9), "id", F.xxhash64("text")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    upto, learn = F.lit(0.0), F.lit(0.0)
    for lang in languages:
        n = counts[lang]
        part = min(1.0, fit_rows / n) * (0.8 if n < fit_rows + calibration_rows else 1.0)
        learn = F.when(F.col("lang") == lang, part).otherwise(learn)
        upto = F.when(F.col("lang") == lang, min(1.0, part + max(calibration_rows / n, 0.0))).otherwise(upto)
    sample = labelled.select("text", "lang", draw.alias("draw"), F.pmod(F.xxhash64("id"), F.lit(SHARDS)).cast("int").alias("shard"))
    sample = sample.filter(F.col("draw") < upto)
    schema = "at binary, x binary, lang string, draw double, shard int"
    sample = store(sample.mapInArrow(_vectors(idf), schema).withColumn("fits", F.col("draw") < learn))
    index = {lang: i for i, lang in enumerate(languages)}
    shape = (BUCKETS, len(languages))
    z, n = np.zeros(shape), np.zeros(shape)
    for _ in range(epochs):
        states = sample.filter("fits").drop("fits").groupBy("shard").applyInArrow(_epoch(z, n, index), "z binary, n binary").collect()
        if not states:
            break
        z = np.mean([np.frombuffer(s["z"]).reshape(shape) for s in states], axis=0)
        n = np.mean([np.frombuffer(s["n"]).reshape(shape) for s in states], axis=0)
    weights = Leader(z, n).weights()
    scored = sample.filter("NOT fits").mapInArrow(_logits(weights), "s array<double>, lang string")
    return Model(languages, idf, weights, temperature(scored, languages))


def strangeness(counts: np.ndarray, idf: np.ndarray) -> float:
    """Share of a text's n-grams that fewer than ``RARE`` of the documents behind ``idf`` hold."""
    return float(counts[idf > 1 - np.log(RARE)].sum() / max(int(counts.sum()), 1))


def predict(
    docs: DataFrame, model: Model, text_col: str = "text", lang: str = "lang_pred", score: str = "score", strange: float = 1.0
) -> DataFrame:
    """Add the predicted language and its calibrated probability to every row of ``docs``.

    A null text, or one without letters, is ``und`` with score 0; so is everything if the model knows no language, and a text
    of which more than the share ``strange`` of n-grams is rare in the documents learned from (1: none).
    Columns of the given names are replaced; the text alone decides.
    """
    idf, weights, heat = model.idf, model.weights, model.temperature
    names = model.languages

    @F.pandas_udf("struct<lang:string,score:double>")
    def judge(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for series in texts:
            langs, scores = [], []
            for text in series:
                counts = _counts(text) if text is not None and names else None
                if counts is None or strange < 1 and strangeness(counts, idf) > strange:
                    langs.append(UNKNOWN)
                    scores.append(0.0)
                    continue
                logits = vector(counts, idf) @ weights / heat
                p = np.exp(logits - logits.max())
                best = int(p.argmax())
                langs.append(names[best])
                scores.append(float(p[best] / p.sum()))
            yield pd.DataFrame({"lang": langs, "score": scores})

    return docs.withColumn("_judged", judge(F.col(text_col))).withColumns(
        {lang: F.col("_judged.lang"), score: F.col("_judged.score")}
    ).drop("_judged")


def held_out(id_col: str | Column = "doc_id") -> Column:
    """Whether ``crc32(id as text) mod 4`` is 2; a null id is not held out (and never learned from)."""
    column = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.coalesce(F.crc32(F.encode(column.cast("string"), "UTF-8")) % 4 == 2, F.lit(False))


def learnable(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    rows = docs.filter(F.col(id_col).isNotNull() & ~held_out(id_col))
    return rows.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
