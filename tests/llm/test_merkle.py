"""The manifest against a plain recursive tree, and its SQL twin."""

import random
import zlib
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from sensorframe.llm import merkle
from sensorframe.llm.queries import ORACLES, QUERIES
from tests.compare import connect, difference

FIELDS = ["doc_id", "lang", "n_chars", "text"]
SCHEMA = "doc_id long, lang string, n_chars int, text string, _g int, _pos string, leaf int, path string"


def h(*parts: str) -> str:
    return sha256("".join(parts).encode()).hexdigest()


def leaf(values) -> str:
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def grown(nodes: list[str]) -> list[list[str]]:
    levels = [nodes]
    while len(levels[-1]) > 1:
        last = levels[-1]
        levels.append([h(*last[i : i + 8]) for i in range(0, len(last), 8)])
    return levels


def siblings(levels: list[list[str]], at: int) -> list[tuple[list[str], list[str]]]:
    out = []
    for row in levels[:-1]:
        first = at - at % 8
        out.append((row[first:at], row[at + 1 : first + 8]))
        at //= 8
    return out


def lowered(text):
    return text and "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def plain(rows):
    """Sorted result rows, by definition."""
    groups: dict = {}
    for r in rows:
        groups.setdefault(r[1], []).append((r[0] is not None, r[0] or 0, leaf(r), r))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: grown([x[2] for x in sorted(groups[g], key=lambda x: x[:3])]) for g in names}
    over = grown([trees[g][-1][0] for g in names])
    out = []
    for seat, g in enumerate(names):
        for at, (_, _, own, r) in enumerate(sorted(groups[g], key=lambda x: x[:3])):
            way = siblings(trees[g], at) + siblings(over, seat)
            changed = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0
            folded = leaf([*r[:3], lowered(r[3])]) if changed else own
            for left, right in way:
                folded = h(*left, folded, *right)
            root = over[-1][0]
            proof = h(*[d for left, right in way for d in left + right])
            out.append((r[0], own, trees[g][-1][0], root, proof, folded, folded == root))
    return sorted(out, key=str)


def tampered(row):
    chosen = F.crc32(row["doc_id"].cast("string").cast("binary")) % 3 == 0
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return {"text": F.when(chosen, F.translate(row["text"], upper, upper.lower())).otherwise(row["text"])}


def rows_of(n: int, langs: int):
    rng = random.Random(n)
    rows = []
    for k in range(n):
        lang = rng.choice([None, "", "zz", "é", *["hot"] * 4, *[f"l{i}" for i in range(langs)]])
        text = rng.choice([None, "", "plain ßÉ", "Öl Äx ABC " * rng.randint(1, 9)])
        rows.append((k if k % 17 else None, lang, rng.choice([None, k, -k]), text))
    return rows + rows[:5] + [(5, "hot", 1, "A" * 2_000_000), (5, "hot", 1, "A" * 2_000_000)]


@pytest.mark.parametrize("n,langs,levels", [(1, 0, 4), (300, 3, 4), (300, 3, 1), (700, 90, 1), (700, 20, 2)])
def test_manifest(spark, n, langs, levels):
    rows = rows_of(n, langs)
    df = spark.createDataFrame([(*r, 1, "x", 2, "y") for r in rows], SCHEMA).repartition(3)
    got = merkle.manifest(df, FIELDS, "doc_id", "lang", tampered, levels=levels)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted(map(tuple, got.collect()), key=str) == plain(rows)


def test_no_rows(spark):
    assert merkle.manifest(spark.createDataFrame([], SCHEMA), FIELDS, "doc_id", "lang", tampered).isEmpty()


def test_versions_share_untouched_nodes():
    tree = merkle.Tree([str(i) for i in range(100)], 3)
    before, size = list(tree.digests), len(tree.digests)
    root = tree.replaced(42, "other")
    assert len(tree.digests) - size == tree.depth + 1 and tree.digests[:size] == before
    assert tree.digests[root] == merkle.fold("other", tree.siblings(42)) != tree.digests[tree.root]
    assert tree.digests[tree.root] == merkle.fold("42", tree.siblings(42))
    again = tree.replaced(42, "42")
    assert tree.digests[again] == tree.digests[tree.root]


def test_sql_gives_the_same_rows(spark):
    sf = "/root/testdata/sf0.001"
    got = QUERIES["op11_merkle"](spark, sf).toPandas()
    assert difference(got, connect(sf).execute(ORACLES["op11_merkle"]).df()) is None
    assert 0 < got["verified"].sum() < len(got)
