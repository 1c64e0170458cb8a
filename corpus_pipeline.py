"""A corpus pipeline: quality filter, near-duplicates, benchmark decontamination, secrets, byte-level BPE.

Every stage takes (spark, docs, folder of the tables) and returns documents; its result is written as Parquet and reread as the
next stage's input. Extra columns of the documents pass through all stages but the last.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from klaxon.llm import bpe, decontaminate, minhash, quality, secrets
from klaxon.llm.shipping import ship
from klaxon.session import materialize


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score reaches the threshold; the machine learns from the labels of rows that are not held out."""
    ship(spark)
    machine = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.score(docs, machine, "__score").where(F.col("__score") >= quality.THRESHOLD).drop("__score")


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five words, similarity 0.8): that of the least doc_id."""
    ship(spark)
    return minhash.deduplicated(docs, (80, 100))


def without_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of ten benchmark words (or a whole shorter item)."""
    ship(spark)
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents; secrets in their texts are masked and n_chars follows."""
    ship(spark)
    return secrets.redacted(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, token_ids, n_tokens, and whether the ids decode to the text again."""
    ship(spark)
    path = public_tokenizers.path("byte_bpe_50k.json")
    rows = bpe.encode_documents(docs.select("doc_id", "lang", "source", "text"), path, decoded="decoded")
    return rows.select("doc_id", "lang", "source", "token_ids", F.size("token_ids").cast("bigint").alias("n_tokens"),
                       (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("round_trip"))


STAGES = [
    ("quality classifier", good_quality),
    ("minhash near-dedup", without_near_duplicates),
    ("benchmark decontamination", without_benchmarks),
    ("secret scans", without_secrets),
    ("bpe encoding and decoding", encoded),
]

# Classifier scores and fitted forests cannot be said in SQL; tests/llm compare each stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return docs
