"""Line labelling: counts against plain Python, decoding and likelihood against enumeration, learning on made lines."""

import itertools
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from sensorframe.llm import lines

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, n_words int, _text string, poor int"


def plain(text):
    text = text or ""
    words = WORD.findall(text)
    windows = Counter(zip(words, words[1:], words[2:]))
    covered = set()
    for k, w in enumerate(zip(words, words[1:], words[2:])):
        if windows[w] > 1:
            covered |= {k, k + 1, k + 2}
    seen, copies = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            copies += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), copies, len(covered)


def texts(seed=4):
    rng = random.Random(seed)
    pool = ["a", "b", "é", "日本", "x|y", "#", "ABC", "!!", "1.", "\x1c", "\x85"]
    out = [None, "", " ", "\n", "\n\n", "a", "a\n", "\na", "a\na", "a\n a", "a\r\na\r\n", "a b c a b c", "a a a a", "日 本\n日 本\n"]
    for _ in range(150):
        seps = rng.choice([" \n", " ", "\n", " \n\n\t\r\x0b"])
        out.append("".join(rng.choice(pool) + rng.choice(seps) * rng.randint(0, 2) for _ in range(rng.randint(0, 40))))
    return out + [rng.choice(pool) * 200_000, "ab cd\n" * 200_000, "", None]


def test_counts(spark):
    rows = list(enumerate(texts())) + [(None, "a b\na b"), (3, "again"), (3, "again")]
    df = spark.createDataFrame([(*r, 1, "clash", 2) for r in rows], SCHEMA).repartition(3)
    got = lines.judge(df, None, ["doc_id"]).collect()
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    assert Counter((r["doc_id"], *[r[c] for c in names]) for r in got) == Counter((i, *plain(t)) for i, t in rows)
    assert all(r["mostly_content"] and r["content_words"] == r["n_words"] and not r["boilerplate"] for r in got)
    assert lines.judge(df.limit(0), None, ["doc_id"]).isEmpty()


def test_words_that_share_a_hash(monkeypatch):
    monkeypatch.setattr(lines, "_HASH", lambda data, start, end: (end - start).astype(np.uint64))
    data = np.frombuffer(b"ab cd ab ef cd", np.uint8)
    ids = lines._word_ids(data, np.array([0, 3, 6, 9, 12]), np.array([2, 5, 8, 11, 14]))
    assert ids.tolist() == [0, 1, 0, 2, 1]


def every(n):
    return [np.array(x, np.int8) for x in itertools.product((0, 1), repeat=n)]


def score(labels, x, w, moves):
    return float((x @ w) @ labels) + sum(moves[a, b] for a, b in zip(labels, labels[1:]))


@pytest.mark.parametrize("seed", range(20))
def test_decoding_and_likelihood(seed):
    rng = np.random.default_rng(seed)
    n, k = int(rng.integers(1, 8)), 3
    x, w, moves = rng.normal(size=(n, k)), rng.normal(size=k), rng.normal(size=(2, 2))
    scores = [score(y, x, w, moves) for y in every(n)]
    total = math.log(sum(map(math.exp, scores)))
    field = lines.Field(w, moves)
    best = field.decode(np.concatenate((x, x)), np.repeat([3, 5], n))
    assert math.isclose(score(best[:n], x, w, moves), max(scores)) and (best[n:] == best[:n]).all()
    labels = every(n)[int(rng.integers(0, 2**n))]
    value, by_w, by_moves = lines.likelihood(x, labels, w, moves)
    assert math.isclose(value, score(labels, x, w, moves) - total, abs_tol=1e-9)
    for i, step in enumerate(np.eye(k) * 1e-6):
        assert abs((lines.likelihood(x, labels, w + step, moves)[0] - value) / 1e-6 - by_w[i]) < 1e-4
    for i, step in enumerate(np.eye(4).reshape(4, 2, 2) * 1e-6):
        assert abs((lines.likelihood(x, labels, w, moves + step)[0] - value) / 1e-6 - by_moves.ravel()[i]) < 1e-4


def test_ties_are_content():
    field = lines.Field(np.zeros(2), np.zeros((2, 2)))
    assert not field.decode(np.ones((4, 2)), np.zeros(4, int)).any() and field.decode(np.ones((0, 2)), np.zeros(0, int)).tolist() == []


def made(seed=9):
    """Good documents of sentences, poor ones of a menu or shouting after a sentence or two; the last are not labelled."""
    rng = random.Random(seed)
    pool = ["".join(rng.choices("abcdefghijklmnoprstu", k=rng.randint(2, 8))) for _ in range(500)]

    def sentence():
        return " ".join(rng.choices(pool, k=rng.randint(6, 20))) + "."

    def junk():
        kind = rng.randrange(3)
        words = rng.choices(pool, k=8)
        return (" | ".join(words), "!! ".join(w.upper() for w in words) + "!!", "Share this page")[kind]

    rows, labels, truth = [], [], {}
    for k in range(400):
        poor = k % 2 == 1
        body = [sentence() for _ in range(rng.randint(1, 2) if poor else rng.randint(3, 9))]
        marks = [False] * len(body)
        if poor:
            body += [junk() for _ in range(rng.randint(6, 12))]
            marks += [True] * (len(body) - len(marks))
        rows.append((k, "\n".join(body), 1, "", 0))
        truth[k] = (body, marks)
        if k < 300:
            labels.append((k, int(not poor)))
    return rows, labels, truth


def test_learning(spark):
    rows, labels, truth = made()
    df = spark.createDataFrame(rows, SCHEMA)
    known = spark.createDataFrame([*labels, (None, 1), (399, None)], "doc_id long, quality int")
    field = lines.fit(df, known, F.col("quality") == 1)
    got = {r["doc_id"]: r for r in lines.judge(df, field, ["doc_id"]).collect()}
    assert all(got[k]["mostly_content"] == (k % 2 == 0) for k in got)
    right = total = 0
    for k in range(300, 400):
        body, marks = truth[k]
        text, spans = "\n".join(body), {(s["start"], s["end"]) for s in got[k]["boilerplate"]}
        assert all(text[a:b] in body for a, b in spans)
        at = 0
        for line, mark in zip(body, marks):
            right, total = right + (((at, at + len(line)) in spans) == mark), total + 1
            at += len(line) + 1
    assert right / total > 0.95


def test_nothing_to_learn_from(spark):
    rows, labels, _ = made()
    df = spark.createDataFrame(rows, SCHEMA)
    known = spark.createDataFrame(labels, "doc_id long, quality int")
    assert lines.fit(df, known.filter("quality = 1"), F.col("quality") == 1) is None
    assert lines.fit(df.limit(0), known, F.col("quality") == 1) is None
    assert lines.fit(df.withColumn("text", F.lit(" \n")), known, F.col("quality") == 1) is None
