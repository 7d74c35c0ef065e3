"""Stages that turn raw documents into token ids of a training corpus."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from sensorframe.llm import language, mixing, neardup, pieces, secrets
from sensorframe.llm.queries import MODEL, domain
from sensorframe.plans.sizing import store

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: a language is accepted from this calibrated probability on (clean texts of one word reach 0.38)
MIN_SCORE = 0.3
#: and if at most this share of the text's n-grams is rare in the documents learned from
STRANGE = 0.15
#: expected tokens of a domain after mixing, as a multiple of what is there
MIX = {"good": 1.0, "poor": 0.5, "toxic": 0.1}


def accept_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; texts that are null, without letters or strange to the model go."""
    model = language.fit(language.learnable(docs))
    judged = language.predict(docs, model, lang="_lang_pred", score="_lang_score", strange=STRANGE)
    known = (F.col("_lang_pred") != language.UNKNOWN) & (F.col("_lang_score") >= MIN_SCORE)
    return judged.filter(known).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five-word shingles, similarity 0.8)."""
    return neardup.keep_one(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets in the text replaced; ``n_chars`` follows."""
    return secrets.redact(docs).withColumn("n_chars", F.char_length("text").cast("long"))


def mix_domains(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn at the rates that meet the domains' token targets."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return mixing.mix(docs, labels, MIX, domain=domain()).apply(docs)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their piece ids."""
    return pieces.encode(docs, pieces.PieceModel.load(MODEL))


STAGES: list[tuple[str, Stage]] = [
    ("language", accept_language),
    ("near_dedup", near_dedup),
    ("secrets", redact_secrets),
    ("mixing", mix_domains),
    ("sentencepiece", encode_pieces),
]

#: the stages are learned models, searches and an encoder, which SQL does not express
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over the documents table, each result written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = store(docs)
    return docs
