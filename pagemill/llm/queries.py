"""The registered queries of the training-data operators, each over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import bpe, decontaminate, html_text, passages, pii, simhash, substrings, toxicity, vectors, warc
from .common import table
from .twins import oracle_sql  # noqa: F401

#: The vocabulary of the BPE query; a file outside the repository.
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def op1_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substrings.deduplicate(table(spark, sf_dir, "documents"), window=13)
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


#: A real run takes its key from a secret store; a fixed one lets results be compared.
PII_KEY = b"pagemill example key"


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = [f"pii_{k}" for k in pii.KINDS]
    return pii.pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"), PII_KEY).select("doc_id", "text", *counts)


def op3_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_duplicates(table(spark, sf_dir, "embeddings"), threshold=0.9)


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), RANKS, public_tokenizers.PATTERN)


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"), min_bytes=0, segment_bytes=16384)


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return toxicity.classify(docs, table(spark, sf_dir, "labels")).drop("text")


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), words=3, distance=3)


def op10_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = passages.deduplicate(table(spark, sf_dir, "documents"), length=50)
    return out.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_substrings": op1_substrings,
        "op2_pii": op2_pii,
        "op3_vectors": op3_vectors,
        "op4_bpe": op4_bpe,
        "op5_decontaminate": op5_decontaminate,
        "op6_warc": op6_warc,
        "op7_html_text": op7_html_text,
        "op8_toxicity": op8_toxicity,
        "op9_simhash": op9_simhash,
        "op10_passages": op10_passages,
    }
