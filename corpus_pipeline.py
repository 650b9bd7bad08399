"""Corpus pipeline: toxicity, near-duplicates, repeated substrings, secrets, packing; each stage reads what the last wrote."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinewave.llm import packing, secrets, simhash, substring_dedup, toxicity
from kinewave.llm.common import written

#: Near-duplicates of the pipeline: shingles of five words, and a similarity of their sets of 0.8 or more.
SHINGLE, SIMILARITY = 5, 0.8


def toxic_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity operator rejects go."""
    return toxicity.without_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates one row stays: that of the smallest doc_id, nulls last, whatever ids the others have.

    Rows are told apart by a key of their own, so repeated rows are copies, and of two texts under one doc_id each is
    judged by itself. Among rows of one doc_id any one stays. Texts without words are no group. The key's name is a new one,
    so that no column of docs is lost.
    """
    key = f"row_{uuid.uuid4().hex}"
    rows = written(docs.withColumn(key, F.monotonically_increasing_id()), "rows")
    found = simhash.similar_rows(rows, SHINGLE, SIMILARITY, key)
    order = F.struct(F.col("doc_id").isNull(), "doc_id", key)
    stays = found.groupBy("root").agg(F.min_by(key, order).alias("stays"))
    gone = written(found.join(stays, "root").where(F.col(key) != F.col("stays")).select(key), "gone", found)
    return rows.join(gone, key, "left_anti").select(*docs.columns)


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes that a repeated 200-byte string covers go, wherever it occurs, as in the operator's own query; documents stay."""
    return substring_dedup.without_repeats(docs)


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a tag; documents stay."""
    return secrets.redacted(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are cut and packed into sequences along the curve; one row per piece."""
    names = (public_tokenizers.path(f"byte_bpe_50k.{kind}") for kind in ("json", "tiktoken"))
    return packing.pack(docs, *names, public_tokenizers.PATTERN)


STAGES = [
    ("toxicity", toxic_stage),
    ("simhash", near_duplicate_stage),
    ("substrings", substring_stage),
    ("secrets", secret_stage),
    ("packing", packing_stage),
]

#: SQL has neither the tokenizer nor the classifier.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over all documents, each written and read again, and then rid of what the one before wrote."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = written(stage(spark, docs, sf_dir), name, *([docs] if k else []))
    return docs
