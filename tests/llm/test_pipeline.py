"""The corpus pipeline and the registered queries on the smallest tables."""

import random

import pytest

import corpus_pipeline
from sensorframe.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_runs(spark, name):
    rows = QUERIES[name](spark, SF)
    assert rows.count() > 0


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before = docs
    sizes = []
    for name, stage in corpus_pipeline.STAGES:
        path_rows = stage(spark, before, SF)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert path_rows.columns == docs.columns
        before = spark.createDataFrame(path_rows.collect(), path_rows.schema)
        sizes.append(before.count())
    assert sizes[0] == docs.count() and sizes[1] < sizes[0] and sizes[2] == sizes[1] and 0 < sizes[4]
    toxic = spark.read.parquet(f"{SF}/labels.parquet").filter("toxic = 1").select("doc_id")
    assert before.join(toxic, "doc_id").count() <= 0.4 * docs.join(toxic, "doc_id").count()
    assert before.filter("ids IS NULL").isEmpty()


def test_language_stage_rejects_what_it_never_saw(spark):
    """Planted foreign texts and letter salad go, every clean document stays."""
    rng = random.Random(4)
    salad = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(n)) for n in (80, 400, 3000)]
    foreign = [
        "Привет мир, это русский текст о погоде и природе нашей страны",
        "zażółć gęślą jaźń, chrząszcz brzmi w trzcinie w Szczebrzeszynie",
        "これは日本語の文章です、天気がとても良いです",
    ]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    planted = [(10**9 + i, t, None, "planted", len(t)) for i, t in enumerate([*salad, *foreign, "", "123 456"])]
    planted.append((10**9 + 50, None, None, None, None))
    whole = docs.unionByName(spark.createDataFrame(planted, docs.schema))
    kept = {r["doc_id"] for r in corpus_pipeline.accept_language(spark, whole, SF).select("doc_id").collect()}
    assert kept == {r["doc_id"] for r in docs.select("doc_id").collect()}
