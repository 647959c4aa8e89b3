"""The corpus pipeline: stages that read documents, each applied to all its predecessor kept.

Toxic documents go, one document of each group of near-duplicates stays, documents that hold
benchmark items go, sources are mixed to their target weights, and the mix is written as token ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from renewlens.llm import decontamination, min_max_hash, mixing, token_ids, toxicity
from renewlens.llm.common import fold, store, table
from renewlens.llm.queries import TOKENIZER


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not toxic, by a model of the labelled ones outside the held-out fold."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), fold("doc_id", 5) != 0)
    return toxicity.without_toxic(docs, model)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that shares 80 percent of its five-word shingles."""
    return min_max_hash.one_of_each(docs, words=5, percent=80)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window that is like a benchmark item."""
    return decontamination.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of the mix, those that are taken twice as two rows."""
    return mixing.mixed_documents(docs)


def token_ids_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of the mix, written as files and read back: a digest for each row."""
    return token_ids.round_trip(docs, tokenizer=TOKENIZER)


STAGES = [
    ("toxicity", toxicity_stage),
    ("MinHash near-dedup", near_dedup_stage),
    ("benchmark decontamination", decontamination_stage),
    ("mixing sources to target weights", mixing_stage),
    ("token-ID / binary output", token_ids_stage),
]

# Compression lengths and the tokenizer are beyond SQL; tests/llm has a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order; each stage's result but the last is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES, start=1):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES):
            docs = store(docs, f"pipeline-{number}")
    return docs
