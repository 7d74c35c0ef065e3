"""The registered queries of this subpackage, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from sensorframe.llm import fingerprint, forest, hardneg, language, lines, merkle, mixing, neardup, packing, pieces, secrets, sharding, substring, twins

Query = Callable[[SparkSession, str], DataFrame]

#: a public model file; the driver reads it once and sends its pieces along
MODEL = "/opt/tokenizers/piece_bpe_32k.model"


def _documents(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/documents.parquet")


def op1_near_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    return neardup.near_duplicates(_documents(spark, sf), shingle=4, percent=80)


#: wanted expected tokens of a domain as a multiple of what is there
MIX = {"good": 1.2, "poor": 0.5, "toxic": 0.1}


def domain() -> Column:
    """Domain of a labelled document: toxic, else good or poor by quality."""
    return F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 1, "good").otherwise("poor")


def op2_mixing(spark: SparkSession, sf: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    mixed = mixing.mix(_documents(spark, sf), labels, MIX, domain=domain())
    shares = [F.col("_p")[i].alias(f"p_{d}") for i, d in enumerate(mixed.model.domains)]
    rated = mixed.rated.select(F.col("_id").alias("doc_id"), F.col("_tokens").alias("n_tokens"), *shares, F.col("_rate").alias("rate"))
    return rated.withColumn("miss", F.lit(mixed.miss))


def op3_substring_dedup(spark: SparkSession, sf: str) -> DataFrame:
    cleaned = substring.remove_repeats(_documents(spark, sf), window=35)
    return cleaned.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op4_sentencepiece(spark: SparkSession, sf: str) -> DataFrame:
    model = pieces.PieceModel.load(MODEL)
    encoded = pieces.encode(_documents(spark, sf).select("doc_id", "text"), model)
    decoded = pieces.decode(encoded, model)
    return decoded.select(
        "doc_id",
        "ids",
        F.coalesce(F.size("ids"), F.lit(0)).alias("n_tokens"),
        F.col("decoded").eqNullSafe(F.col("text")).alias("exact"),
    )


def op5_fingerprints(spark: SparkSession, sf: str) -> DataFrame:
    return fingerprint.fingerprints(_documents(spark, sf))


def op6_packing(spark: SparkSession, sf: str) -> DataFrame:
    model = pieces.PieceModel.load(MODEL)
    encoder = pieces.encoder(model, ["id", "text"], library=True)
    return packing.pack(_documents(spark, sf), length=2048, ids_col="text", vocabulary=len(model.pieces), encoder=encoder)


def op7_secrets(spark: SparkSession, sf: str) -> DataFrame:
    found = secrets.scan(_documents(spark, sf), ["doc_id"])
    base = F.filter("spans", lambda s: s["kind"] != "random")

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id",
        count("assign"),
        count("access"),
        count("hex"),
        F.sha2(secrets.written(base), 256).alias("base_sha256"),
        secrets.written(F.col("spans")).alias("spans"),
        count("random"),
    )


def op8_hash_forest(spark: SparkSession, sf: str) -> DataFrame:
    return forest.neighbours(spark.read.parquet(f"{sf}/embeddings.parquet"), lambda vec_id: vec_id % 50 == 0)


def op9_language(spark: SparkSession, sf: str) -> DataFrame:
    docs = _documents(spark, sf)
    model = language.fit(language.learnable(docs))
    predicted = language.predict(docs.select("doc_id", "text"), model)
    return predicted.select("doc_id", language.held_out().alias("held_out"), "lang_pred", "score")


def op10_sharding(spark: SparkSession, sf: str) -> DataFrame:
    return sharding.place(_documents(spark, sf), 40)


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def op11_merkle(spark: SparkSession, sf: str) -> DataFrame:
    def tampered(row: dict[str, Column]) -> dict[str, Column]:
        chosen = F.crc32(row["doc_id"].cast("string").cast("binary")) % 3 == 0
        return {"text": F.when(chosen, F.translate(row["text"], UPPER, LOWER)).otherwise(row["text"])}

    return merkle.manifest(_documents(spark, sf), ["doc_id", "source", "lang", "n_chars", "text"], "doc_id", "lang", tampered)


def op12_line_quality(spark: SparkSession, sf: str) -> DataFrame:
    docs = _documents(spark, sf)
    field = lines.fit(docs, spark.read.parquet(f"{sf}/labels.parquet"), F.col("quality") == 1)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return lines.judge(docs, field, ["doc_id"]).select(
        "doc_id", *counts, failed.alias("base_failed"), (~failed & F.col("mostly_content")).alias("kept"), "content_words"
    )


def op13_hard_negatives(spark: SparkSession, sf: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf}/embeddings.parquet")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hardneg.mine(vectors, F.col("vec_id") % 50 == 0, label=label)


QUERIES: dict[str, Query] = {
    "op1_near_duplicates": op1_near_duplicates,
    "op2_mixing": op2_mixing,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_sentencepiece": op4_sentencepiece,
    "op5_fingerprints": op5_fingerprints,
    "op6_packing": op6_packing,
    "op7_secrets": op7_secrets,
    "op8_hash_forest": op8_hash_forest,
    "op9_language": op9_language,
    "op10_sharding": op10_sharding,
    "op11_merkle": op11_merkle,
    "op12_line_quality": op12_line_quality,
    "op13_hard_negatives": op13_hard_negatives,
}

ORACLES: dict[str, str] = {"op11_merkle": twins.MERKLE, "op13_hard_negatives": twins.HARD_NEGATIVES}
