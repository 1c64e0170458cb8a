"""Registered queries of the subpackage and the SQL they must equal."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import archives, bpe, decontaminate, forest, infill, minhash, negatives, quality, rules, secrets, sharding, wavelet, wrapper
from .shipping import ship

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf}/{name}.parquet")


@query
def op4_jump_shards(spark, sf):
    return sharding.shard_documents(_table(spark, sf, "documents"))


@query
def op1_secret_findings(spark, sf):
    return secrets.findings(_table(spark, sf, "documents"))


@query
def op2_nearest_vectors(spark, sf):
    vectors = _table(spark, sf, "embeddings")
    return forest.neighbours(vectors, vectors.where("vec_id % 100 = 0"))


@query
def op3_near_duplicates(spark, sf):
    return minhash.near_duplicates(_table(spark, sf, "documents"))


@query
def op5_benchmark_windows(spark, sf):
    rows = decontaminate.measure(_table(spark, sf, "documents"), _table(spark, sf, "benchmark"))
    return rows.drop("key")


@query
def op6_wavelet_shards(spark, sf):
    return wavelet.documents_through_shards(_table(spark, sf, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query
def op7_page_text(spark, sf):
    return wrapper.extract_pages(_table(spark, sf, "pages"))


@query
def op8_quality_machine(spark, sf):
    return quality.quality_of_documents(_table(spark, sf, "documents"), _table(spark, sf, "labels"))


@query
def op9_byte_bpe(spark, sf):
    return bpe.digests(_table(spark, sf, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query
def op10_arc_to_warc(spark, sf):
    rows = archives.pages_through_warc(_table(spark, sf, "pages"))
    return rows.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query
def op11_infilled_documents(spark, sf):
    return infill.digests(_table(spark, sf, "documents"))


@query
def op12_hard_negatives(spark, sf):
    vectors = _table(spark, sf, "embeddings").withColumn("label", negatives.relabelled())
    return negatives.mine(vectors, vectors.where("vec_id % 100 = 0"))


@query
def op13_quality_rules(spark, sf):
    return rules.verdicts(_table(spark, sf, "documents"))


def sql() -> dict[str, str]:
    return {"op3_near_duplicates": minhash.sql(), "op4_jump_shards": sharding.sql(), "op5_benchmark_windows": decontaminate.sql(), "op10_arc_to_warc": archives.sql(),
            "op11_infilled_documents": infill.sql(), "op12_hard_negatives": negatives.sql(), "op13_quality_rules": rules.sql()}
