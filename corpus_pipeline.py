"""From documents to token ids: quality, near duplicates, benchmark passages, secrets, tokens."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shoal.llm import bpe, decontaminate, minhash, quality, secret_scan
from shoal.plans.registry import table
from shoal.session import fresh_path

#: SQL cannot express the classifier; the tests compare the stages with brute force.
ORACLE_SQL = None

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learned from the labelled ones among them, doesn't reject."""
    model = quality.fit(quality.features(docs), table(spark, sf_dir, "labels"))
    return quality.reject(docs, model)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five-word shingles, similarity of 0.8 or more)."""
    return minhash.drop_near_duplicates(docs, shingle_words=5, percent=80)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which benchmark passages make less than a twentieth."""
    return decontaminate.remove_contaminated(docs, table(spark, sf_dir, "benchmark"))


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced by their kind."""
    return secret_scan.redact(docs, length_col="n_chars")


def byte_level_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, checked by decoding them."""
    encoded = bpe.encode(docs, RANKS, public_tokenizers.PATTERN)
    return bpe.decode(encoded, RANKS).select(
        "doc_id", "n_tokens", "ids", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("quality classifier", quality_classifier), ("near duplicates", near_duplicates),
          ("benchmark decontamination", benchmark_decontamination), ("secret scans", secret_scans),
          ("byte-level BPE", byte_level_bpe)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each stage is written in the shared folder and read again by the next one."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = fresh_path(spark, name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
