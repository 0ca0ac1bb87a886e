"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_bpe, chat, decontaminate, fingerprints, langid, merkle, ngram_join, pii, quality, sharding, toxicity, warc, whitening
from .common import held_out, table


def bpe_vocabulary() -> tuple[str, str]:
    """Path of the rank file and the split pattern: parameters of the tokenizer operator."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontaminate.leaks(docs, table(spark, sf_dir, "benchmark")).drop("text_hash")


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality.described(table(spark, sf_dir, "documents"))
    model = quality.learn(rows, table(spark, sf_dir, "labels"))
    return quality.scored(rows, model).select(
        "doc_id", held_out("doc_id", 5, 0).alias("held_out"), "score", F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted")
    )


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.linked(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text_hash")


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return byte_bpe.digests(byte_bpe.encode_and_decode(docs, *bpe_vocabulary()))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.learn(docs, table(spark, sf_dir, "labels"))
    return toxicity.scored(docs, model).select(
        "doc_id", held_out("doc_id", 3, 1).alias("held_out"), "score", F.when(F.col("score") >= 0.7, 1).otherwise(0).alias("predicted")
    )


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprinted(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op9_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = chat.with_control_conversation(table(spark, sf_dir, "conversations"))
    return chat.read_back(chat.examples(rows))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.sharded(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.report(table(spark, sf_dir, "embeddings"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(table(spark, sf_dir, "documents"))


def op13_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    got = langid.identified(docs.select("doc_id", "text"), langid.learn(docs))
    return got.select("doc_id", held_out("doc_id", 5, 0).alias("held_out"), "lang_pred", "score", "rejected")


QUERIES = {
    "op1_decontamination": op1_decontamination,
    "op2_quality": op2_quality,
    "op3_ngram_join": op3_ngram_join,
    "op4_byte_bpe": op4_byte_bpe,
    "op5_toxicity": op5_toxicity,
    "op6_fingerprints": op6_fingerprints,
    "op7_pii": op7_pii,
    "op8_warc": op8_warc,
    "op9_chat_formatting": op9_chat_formatting,
    "op10_sharding": op10_sharding,
    "op11_whitening": op11_whitening,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_language_id": op13_language_id,
}

ORACLES: dict[str, str] = {"op1_decontamination": decontaminate.ORACLE, "op3_ngram_join": ngram_join.ORACLE, "op8_warc": warc.ORACLE, "op9_chat_formatting": chat.ORACLE, "op12_merkle_manifest": merkle.ORACLE}
