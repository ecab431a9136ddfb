"""From documents to packed training sequences, in five stages that each call one operator of textquarry.llm.

Every stage takes the rows its predecessor kept and returns the columns of documents (the last one: pieces of packed
sequences). Nulls in any column and empty texts pass through: such a text is not toxic, has no near copies, no
benchmark passage and no secrets, and packs as its end id alone. Rows that repeat a doc_id stay or go together.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textquarry.llm import decontam, jaccard_join, packing, secret_scan, toxicity
from textquarry.llm.common import save, table, without

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain rejects as toxic go. It is trained on labels and documents of sf_dir."""
    chain = toxicity.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), toxicity.default_categories())
    return toxicity.classify(docs.select(COLUMNS), chain).filter(~F.col("toxicity.is_toxic")).select(COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that five-word shingles with a Jaccard similarity of 0.8 or more connect, the smallest doc_id stays."""
    classes = jaccard_join.link(docs, width=5, percent=80)
    return without(docs.select(COLUMNS), save(classes.filter("component_id <> doc_id").select("doc_id").distinct(), "copies"))


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold at least half of a benchmark item, in any order, go."""
    return decontam.match(docs.select(COLUMNS), table(spark, sf_dir, "benchmark")).filter(F.size("matches") == 0).select(COLUMNS)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked in the text, and n_chars follows; every document stays."""
    masked = secret_scan.redact(secret_scan.scan(docs.select(COLUMNS).withColumn("was", F.col("text"))))
    return masked.withColumn("n_chars", F.when(F.col("text").eqNullSafe(F.col("was")), F.col("n_chars")).otherwise(F.length("text").cast("long"))).select(COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 2048 tokens: doc_id, start, length, ids, doc_tokens, sequence_id, offset."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", drop_near_copies),
    ("benchmark_decontamination", drop_leaks),
    ("secret_scans", mask_secrets),
    ("packing", pack_sequences),
]

#: Models, components and tokenizers are beyond SQL; tests/llm/test_pipeline.py compares with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = save(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
