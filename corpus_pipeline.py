"""A corpus pipeline of five stages, each a Spark job over all its predecessor kept.

Toxic documents go; of near copies one stays; documents that leak benchmark items go; personal data
is replaced by its kind in brackets; what is left is tokenised.  Every stage is written as Parquet
and read again, so a lost executor costs at most one stage's tasks.

Defined results: a null text passes every stage and has no tokens; empty and very long texts are
treated like others; of rows equal in id and text one stays; extra columns of any name are kept by
every stage (those named like the last stage's new columns are replaced); an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cliploom.llm import byte_bpe, decontaminate, ngram_join, pii, toxicity
from cliploom.llm.common import scratch, table
from cliploom.llm.queries import bpe_vocabulary


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.without_toxic(docs, table(spark, sf_dir, "labels"))


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.one_of_each(docs)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.redacted(docs)


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their token ids (little-endian uint32), count and digest."""
    coded = byte_bpe.encode_and_decode(docs, *bpe_vocabulary(), keep_decoded=False)
    return coded.withColumns({"n_tokens": (F.octet_length("token_ids") / 4).cast("long"), "ids_sha256": F.sha2("token_ids", 256)})


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", keep_one_of_near_copies),
    ("benchmark_decontamination", drop_benchmark_leaks),
    ("personal_data", redact_personal_data),
    ("byte_level_bpe", tokenise),
]

#: A classifier and a tokenizer are beyond SQL; tests compare with brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
