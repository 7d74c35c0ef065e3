"""Mixing by soft membership, in DataFrame expressions alone.

A classifier learned from a labelled table gives every document a posterior over domains.  Each
document then gets a nonnegative rate (expected number of copies) such that the expected
tokens of every domain meet a target: least squares over the rates, solved by projected gradient.

Minimised is the squared distance of the sums ``S_k = sum_i rate_i * tokens_i * p_ik`` from the targets ``T_k``.  Its gradient for
a document is its posterior times ``S - T``; in the metric of the documents whose rate is positive (their
posteriors' K x K overlap, weighted by tokens) one step would meet the targets, were it not for the projection to rates from 0 on, so
few steps are needed.  A step reads one row of sums to the driver.  It changes a rate by an amount that the
posterior alone decides, so the rates of any table follow from its texts, the word model and the steps: applying
them needs no join and moves no text.
"""

from __future__ import annotations

import math
import warnings
from collections.abc import Mapping
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from sensorframe.plans.sizing import store

#: telling words of the model at most (those that tell most), and slots of the table in which they are looked up
WORDS, SLOTS = 512, 1 << 16
#: labelled rows the classifier is fitted on, for each domain (about; rows are picked by a hash of the id)
FIT_ROWS = 2000
#: beyond this many words, evidence is averaged, so that long texts keep soft posteriors
EVIDENCE = 200
#: chi-squared and factor between two domains' shares from which a word tells something
TELLING, FACTOR = 30.0, 4.0
#: steps whose rates are recomputed from one stored table
FUSED = 8

SEPARATOR = r"[\x20\x09-\x0D]+"


def _words(text: Column) -> Column:
    """The words of a text; a separator at either end leaves an empty one there."""
    return F.split(F.lower(F.coalesce(text, F.lit(""))), SEPARATOR)


def _fit_rows(labels: DataFrame, fit_rows: int) -> tuple[DataFrame, dict[str, int]]:
    """About ``fit_rows`` ids of every domain, and the number of labelled ids per domain, in order."""
    labels = labels.filter("_id IS NOT NULL AND _domain IS NOT NULL").distinct()
    counts = {r["_domain"]: r["count"] for r in labels.groupBy("_domain").count().collect()}
    domains = sorted(counts)
    share = F.lit(0.0)
    for domain in domains:
        share = F.when(F.col("_domain") == domain, F.lit(fit_rows / counts[domain])).otherwise(share)
    draw = F.pmod(F.xxhash64(F.lit("fit"), "_id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return labels.filter(draw < share), {d: counts[d] for d in domains}


@dataclass
class WordModel:
    """Naive Bayes of domains: log of their shares of the labelled documents, and log-likelihoods of telling and of all other words.

    Likelihoods are relative to a word's overall share.  Telling words are known by their 64-bit hashes.
    """

    domains: list[str]
    prior: list[float]
    plain: list[float]
    hashes: list[int]
    weights: list[list[float]]


def word_model(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> WordModel:
    """Multinomial naive Bayes over words.

    A word whose counts differ between domains by no more than chance (chi-squared up to ``TELLING``), or by less than ``FACTOR``,
    tells nothing beyond the domain's share of such words: chance differences of many rare words, and small ones of common words
    that go with the language, would otherwise outweigh the few words that matter.  Equal texts are fitted on once.  At most ``WORDS`` telling words are kept; of two in one slot of the lookup table the more telling one.

    ``docs`` has ``_id, _text``; ``labels`` has ``_id, _domain``.  The fit uses about ``fit_rows`` labelled documents per
    domain, a size-bounded table that is broadcast.
    """
    picked, labelled = _fit_rows(labels, fit_rows)
    domains = list(labelled)
    if not domains:
        return WordModel([], [], [], [], [])
    fitted = docs.join(F.broadcast(store(picked)), "_id").dropDuplicates(["_domain", "_text"]).select("_domain", F.explode(_words(F.col("_text"))).alias("_w"))
    counts = fitted.filter("_w <> ''").groupBy(F.xxhash64("_w").alias("_h")).pivot("_domain", domains).count().fillna(0)
    counts = store(counts.toDF("_h", *[f"c{i}" for i in range(len(domains))]))
    columns = [F.col(f"c{i}") for i in range(len(domains))]
    totals = [float(x or 0.0) for x in counts.agg(*[F.sum(c) for c in columns]).first()]
    everywhere, whole = sum(columns, F.lit(0)), max(sum(totals), 1.0)
    expected = [everywhere * F.lit(t / whole) for t in totals]
    chance = sum((F.when(e > 0, (c - e) * (c - e) / e).otherwise(0.0) for c, e in zip(columns, expected)), F.lit(0.0))
    rates = [(c + 1) / (t + 1) for c, t in zip(columns, totals)]
    apart = F.greatest(*rates) / F.least(*rates) >= FACTOR if len(rates) > 1 else F.lit(False)
    found = counts.withColumn("_chi", chance).filter((F.col("_chi") > TELLING) & apart).orderBy(F.desc("_chi"), "_h").limit(WORDS).collect()
    taken: dict[int, list[float]] = {}
    for row in found:
        if row["_h"] % SLOTS not in {h % SLOTS for h in taken}:
            taken[row["_h"]] = [float(row[f"c{i}"]) for i in range(len(domains))]
    rest = [t - sum(c[i] for c in taken.values()) for i, t in enumerate(totals)]
    free = [t + 1 + len(taken) for t in totals]
    plain = [math.log((r + 1) / f) for r, f in zip(rest, free)]
    calm = max(sum(rest) / whole, 1e-300)
    weights = [[math.log((x + 1) / f / (sum(c) / whole) * calm) for x, f in zip(c, free)] for c in taken.values()]
    prior = [math.log(n / sum(labelled.values())) for n in labelled.values()]
    return WordModel(domains, prior, plain, list(taken), weights)


def _constant(values: list, kind: str) -> Column:
    """An array that the optimizer makes a constant."""
    return F.split(F.lit(",".join(map(repr, values))), ",").cast(f"array<{kind}>")


def _membership(text: Column, model: WordModel) -> Column:
    """Number of words ``n`` and posterior array ``p`` of a text, from the text alone.

    A text without words gets the domains' overall shares; without domains the array is empty.
    """
    k, words = len(model.domains), _words(text)
    ends = F.when(F.element_at(words, -1) == "", 1).otherwise(0) + F.when((F.size(words) > 1) & (F.get(words, F.lit(0)) == ""), 1).otherwise(0)
    n = (F.size(words) - ends).cast("long").alias("n")
    if not k:
        return F.struct(n, F.array().cast("array<double>").alias("p"))
    places = [0] * SLOTS  # place 0 is no word
    for i, h in enumerate(model.hashes):
        places[h % SLOTS] = i + 1
    slots, hashes = _constant(places, "int"), _constant([0, *model.hashes], "long")
    weights = [_constant([0.0, *[w[i] - model.plain[i] for w in model.weights]], "double") for i in range(k)]

    def place(word: Column) -> Column:
        return F.get(slots, F.pmod(F.xxhash64(word), F.lit(SLOTS)).cast("int"))

    told = F.transform(F.filter(words, lambda w: F.get(hashes, place(w)) == F.xxhash64(w)), place) if model.hashes else F.array().cast("array<int>")
    start = F.struct(n, *[F.lit(0.0).alias(f"l{i}") for i in range(k)])

    def add(total: Column, at: Column) -> Column:
        return F.struct(total["n"].alias("n"), *[(total[f"l{i}"] + F.get(weights[i], at)).alias(f"l{i}") for i in range(k)])

    def shares(total: Column) -> Column:
        shrink = F.least(F.lit(1.0), F.lit(float(EVIDENCE)) / F.greatest(total["n"], F.lit(1)))
        logs = [(total[f"l{i}"] + total["n"] * model.plain[i]) * shrink + F.lit(model.prior[i]) for i in range(k)]
        top = F.greatest(*logs) if k > 1 else logs[0]
        parts = F.array(*[F.exp(x - top) for x in logs])
        whole = F.aggregate(parts, F.lit(0.0), lambda a, x: a + x)
        return F.struct(total["n"].alias("n"), F.transform(parts, lambda x: x / whole).alias("p"))

    return F.aggregate(told, start, add, shares)


def _stepped(rate: Column, step: list[float]) -> Column:
    """The projected step: less by the posterior times ``step``, but not below 0."""
    return F.greatest(F.lit(0.0), rate - sum((F.col("_p")[i] * F.lit(g) for i, g in enumerate(step)), F.lit(0.0)))


def fit_rates(members: DataFrame, targets: list[float], tolerance: float = 1e-4, max_iter: int = 60) -> tuple[DataFrame, list[list[float]], float]:
    """Add ``_rate`` to ``(_tokens, _p, ...)``; also the steps taken from rate 1 and the largest remaining miss, as a share of all targets.

    Stops when the miss is at most ``tolerance``, or when steps a thousandth as long do not lower it (targets out of reach).
    """
    k = len(targets)
    table, rate, fused = store(members.withColumn("_rate", F.lit(1.0))), F.col("_rate"), 0
    weight = [F.col("_tokens") * F.col("_p")[i] for i in range(k)]
    pairs = [(i, j) for i in range(k) for j in range(i, k)]

    def summed(rate: Column) -> tuple[np.ndarray, np.ndarray]:
        """Sums per domain, and the overlap of domains in documents whose rate is positive."""
        rows = table.withColumn("_r", rate)
        shared = [F.sum(F.when(F.col("_r") > 0, weight[i] * F.col("_p")[j])) for i, j in pairs]
        row = [float(x or 0.0) for x in rows.agg(*[F.sum(F.col("_r") * w) for w in weight], *shared).first()]
        overlap = np.zeros((k, k))
        for (i, j), v in zip(pairs, row[k:]):
            overlap[i, j] = overlap[j, i] = v
        return np.array(row[:k]), overlap

    if not k:
        return table, [], 0.0
    wanted, scale = np.array(targets), max(sum(targets), 1e-12)
    sums, overlap = summed(rate)
    steps, length, miss = [], 1.0, float(np.abs(sums - wanted).max() / scale)
    if not sums.sum():
        return table, [], 0.0
    for _ in range(max_iter):
        if miss <= tolerance or length < 1e-3:
            break
        step = (length * (np.linalg.pinv(overlap, rcond=1e-10) @ (sums - wanted))).tolist()
        tried = _stepped(rate, step)
        new_sums, new_overlap = summed(tried)
        new_miss = float(np.abs(new_sums - wanted).max() / scale)
        if new_miss >= miss:
            length /= 4
            continue
        steps.append(step)
        rate, sums, overlap, miss, length, fused = tried, new_sums, new_overlap, new_miss, min(1.0, 2 * length), fused + 1
        if fused == FUSED:
            table, rate, fused = store(table.withColumn("_rate", rate)), F.col("_rate"), 0
    return table.withColumn("_rate", rate), steps, miss


@dataclass
class Mix:
    """The word model, the steps that lead to the rates, the remaining miss, and the rated documents ``(_id, _tokens, _p, _rate)``."""

    model: WordModel
    steps: list[list[float]]
    miss: float
    rated: DataFrame

    def apply(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """Repeat every row ``floor(rate)`` times and once more with the rate's fraction as probability.

        Posterior and rate are worked out in the row.  The draw is a hash of the id and the text, so it is the same in every
        run, and rows that are equal in both share their fate.  Returns the columns of ``docs``.
        """
        columns = docs.columns
        rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("_row"))
        text = F.col("_row")[text_col]
        rate: Column = F.lit(1.0)
        for step in self.steps:
            rate = _stepped(rate, step)
        key = F.xxhash64(F.lit("mix"), F.col("_row")[id_col], text)
        draw = F.pmod(key, F.lit(1 << 30)) / F.lit(float(1 << 30))
        whole = F.floor("_rate")
        times = (whole + F.when(draw < F.col("_rate") - whole, 1).otherwise(0)).cast("int")
        rated = rows.withColumn("_p", _membership(text, self.model)["p"]).withColumn("_rate", rate).select("_row", times.alias("_times"))
        # a filter on the rate, or an inner explode, would be worked out twice: the optimizer moves it below the posterior
        copies = rated.select("_row", F.explode_outer(F.array_repeat(F.lit(True), "_times")).alias("_copy")).filter("_copy")
        return copies.select(*[F.col("_row")[c].alias(c) for c in columns])


def mix(
    docs: DataFrame,
    labels: DataFrame,
    targets: Mapping[str, float],
    id_col: str = "doc_id",
    text_col: str = "text",
    domain: Column | None = None,
    fit_rows: int = FIT_ROWS,
    tolerance: float = 1e-4,
    max_iter: int = 60,
) -> Mix:
    """Rates for ``docs`` that meet the domains' targets; a warning tells when they are missed by more than ``tolerance``.

    ``labels`` has ``id_col`` and whatever ``domain`` (default: column ``domain``) is made of.  ``targets`` maps a domain to
    the wanted tokens as a multiple of its natural expected total (1 leaves it as it is); a domain that is not named
    keeps 1.  Every row is rated by its own text, whatever its length; repeated rows get equal rates.
    Null ids take part but are never fitted on; null and empty texts have no tokens and the labels' shares as posterior.  Without labels, or without
    words, all rates are 1; an empty table gives no rows.  Other columns are not read.
    """
    base = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    tagged = labels.select(F.col(id_col).alias("_id"), (F.col("domain") if domain is None else domain).alias("_domain"))
    model = word_model(base, tagged, fit_rows)
    members = base.withColumn("_m", _membership(F.col("_text"), model))
    members = store(members.select("_id", F.col("_m.n").alias("_tokens"), F.col("_m.p").alias("_p")))
    shares = [F.sum(F.col("_tokens") * F.col("_p")[i]) for i in range(len(model.domains))]
    natural = members.agg(*shares).first() if shares else []
    wanted = [float(n or 0.0) * float(targets.get(d, 1.0)) for n, d in zip(natural, model.domains)]
    rated, steps, miss = fit_rates(members, wanted, tolerance, max_iter)
    if miss > tolerance:
        warnings.warn(f"targets are missed by {miss:.1e} of all tokens", stacklevel=2)
    return Mix(model, steps, miss, rated)
