"""The registered queries of the corpus operators, each over whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import ann, byte_bpe, centroids, oracle, packing, resampling, secrets, simhash, substring_dedup, token_counts, topk, toxicity, url_filter, warc

BPE_RANKS, BPE_FILE = "byte_bpe_50k.tiktoken", "byte_bpe_50k.json"
PIECES = "piece_bpe_32k.model"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity scores of all documents; voters, label model and classifier are fitted outside the held-out fold."""
    return toxicity.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of all documents by the piece vocabulary."""
    return token_counts.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path(PIECES))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of all documents that repeated 200-byte strings cover."""
    return substring_dedup.repeated_substrings(table(spark, sf_dir, "documents"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents cut and packed along the curve into sequences of 1024 ids."""
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path(BPE_FILE), public_tokenizers.path(BPE_RANKS), public_tokenizers.PATTERN)


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A verdict for every page, by rules or by trust and distrust of its host."""
    return url_filter.judge(table(spark, sf_dir, "pages"))


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of all documents by the byte-level ranks, and what they decode to."""
    return byte_bpe.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path(BPE_RANKS), public_tokenizers.PATTERN)


def op7_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest found of every 20th vector among all vectors."""
    return ann.neighbours(table(spark, sf_dir, "embeddings"))


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in all documents: base patterns and entropy spans."""
    return secrets.secret_spans(table(spark, sf_dir, "documents"))


def op9_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The exact five best of every 50th vector among all vectors."""
    return topk.top_k(table(spark, sf_dir, "embeddings"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents, and the groups within four bits."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All vectors of 64 components in 40 clusters, after five rounds."""
    return centroids.clusters(table(spark, sf_dir, "embeddings"))


def op12_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages as records of normalised archives, read back by their index."""
    return warc.archived(table(spark, sf_dir, "pages"))


def op13_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents weighted towards the benchmark texts, and a tenth of those of 20 words or more drawn."""
    return resampling.resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (op1_toxicity, op2_token_counts, op3_substring_dedup, op4_packing, op5_url_filter, op6_byte_bpe, op7_ann, op8_secrets, op9_topk, op10_simhash, op11_centroids, op12_warc, op13_resampling)
    return {f.__name__: f for f in every}


def oracle_sql() -> dict[str, str]:
    return dict(oracle.SQL)
