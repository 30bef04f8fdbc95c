"""The corpus pipeline: quality rules, near duplicates, benchmark, secrets, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it kept. It
is written as Parquet and read again before the next one. All but the last return the
columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathweave.llm import decontamination, jaccard_join, packing, quality_rules, secrets
from pathweave.llm.common import stage_table, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a rule of the production policy rejects go."""
    return quality_rules.keep_good(docs, "v1")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the smallest id stays. As in all
    near-duplicate stages a shingle has five words and the similarity is 0.8."""
    return jaccard_join.keep_one(docs, size=5, threshold=80)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold too much of the benchmark go."""
    return decontamination.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def hide_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every secret in a text is replaced by a sign; ``n_chars`` follows the text."""
    masked = secrets.mask(docs)
    return masked.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 4096 tokens. Workers keep few chunks in
    mind, as they still hold what the stages before have left."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=2, cache_chunks=100_000)


STAGES = [
    ("quality rules", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontaminate),
    ("secret scans", hide_secrets),
    ("packing", pack),
]

#: A CRF and a tokenizer have no SQL; the tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stage_table(stage(spark, docs, sf_dir), "pipeline")
    return STAGES[-1][1](spark, docs, sf_dir)
