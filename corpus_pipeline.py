"""The corpus pipeline: five stages over `documents`, each written as Parquet and read again as the next one's input.

Stage by stage: toxic documents go; one document of each group of near duplicates stays; documents that hold a
benchmark item go; personal data is replaced by pseudonyms; the rest is encoded with byte-level BPE and decoded
again as proof. All stages but the last return the columns of documents.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from pagemill.llm import bpe, decontaminate, pii, simhash, toxicity
from pagemill.llm.common import delete, shared_dir, table
from pagemill.llm.queries import PII_KEY, RANKS


def _on_own_columns(docs: DataFrame, operator: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """operator(docs) with the columns of docs alone. The operator sees doc_id, text and n_chars; the others, whatever
    their names, are set aside under numbers and come through unchanged."""
    seen = {"doc_id", "text", "n_chars"}
    names = [c if c in seen else f"column {k}" for k, c in enumerate(docs.columns)]
    out = operator(docs.toDF(*names))
    return out.select(*[F.col(f"`{n}`").alias(c) for n, c in zip(names, docs.columns, strict=True)])


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain, fitted on the labels of the whole table, doesn't call toxic.

    Null and empty texts hold no toxic term and stay, repeated rows each; without labels of both kinds all rows stay.
    """
    chain = toxicity.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return _on_own_columns(docs, lambda d: toxicity.score(d, chain).where("p_toxic < 0.5"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first row, by doc_id, of each group of documents linked by a similarity of 0.8 of their five-word shingles.

    The pigeonring's links of SimHash fingerprints come first, an exact filter finds the rest, the shingles decide.
    Null and empty texts are one group; null ids come last; of wholly equal rows one stays.
    """
    return simhash.representatives(docs, words=5, similarity=0.8)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window that is similar to a benchmark item. Null and empty texts stay, repeated rows each."""
    items = table(spark, sf_dir, "benchmark")
    return _on_own_columns(docs, lambda d: decontaminate.flag(d, items).where(F.size("leaks") == 0))


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with pseudonyms; n_chars, where it is known, follows the text. Null texts stay null, empty ones empty."""
    length = F.when(F.col("n_chars").isNotNull(), F.coalesce(F.length("text"), F.col("n_chars"))).cast("long")
    return _on_own_columns(docs, lambda d: pii.pseudonymise(d, PII_KEY).withColumn("n_chars", length))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row; a null text is encoded as the empty one."""
    return bpe.digests(docs, RANKS, public_tokenizers.PATTERN)


STAGES = [
    ("toxicity", toxic),
    ("near duplicates", near_duplicates),
    ("decontamination", benchmark),
    ("private data", private),
    ("tokenize", tokenize),
]

#: SQL expresses neither the classifier, nor SimHash linking, nor BPE.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; the rows of the last. A stage's table goes once the next one is written."""
    folder = f"{shared_dir(spark)}/pagemill-pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        if k:
            delete(spark, f"{folder}/{k - 1}")
    return docs
