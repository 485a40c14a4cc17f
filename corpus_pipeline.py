"""A corpus in five stages: quality, near duplicates, decontamination, secrets, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one before kept; the result is
written as Parquet and read again as the next one's docs. All but the last return the columns of docs.

Edge cases are those of the operators: null and empty texts are rejected by the first stage, as they
have no words; a null doc_id is kept and its rows are deduplicated like others; repeated rows are
duplicates of each other; empty tables pass through; other columns are carried along untouched.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from kinlink.llm import decontaminate, packing, quality, secrets, simhash
from kinlink.llm.common import shared_dir


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that a rule of the cascade rejects go."""
    return quality.passing(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each near-duplicate class stays: fingerprint or band links with a shingle similarity of 0.8 or more."""
    return simhash.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows with a benchmark window go."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in texts are replaced by a mark; no row goes."""
    import public_tokenizers

    return secrets.redacted(docs, vocabulary=public_tokenizers.path("word_bpe_49k.json"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the texts, each with its sequence and offset.

    Workers that other stages use as well remember fewer chunks, which costs time but not memory.
    """
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), kept=100_000)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secret_scan", secret_scan),
    ("best_fit_packing", best_fit_packing),
]

#: Fingerprints, guess costs and token ids have no SQL twin; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what lies between two stages is written to the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    base = f"{shared_dir(spark).rstrip('/')}/kinlink-pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{name}")
        docs = spark.read.parquet(f"{base}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
