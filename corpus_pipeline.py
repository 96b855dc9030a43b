"""Corpus preparation in five stages; each takes (spark, docs, sf_dir) and its rows are written before the next one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sedimenta.llm.benchmarks import without_benchmarks
from sedimenta.llm.common import table
from sedimenta.llm.language_id import of_known_language
from sedimenta.llm.secrets import without_secrets
from sedimenta.llm.sentencepiece_codec import tokenized
from sedimenta.llm.simhash import one_of_each_group
from sedimenta.session import written

STAGES = [
    ("language_id", of_known_language),
    ("simhash_near_dedup", one_of_each_group),
    ("benchmark_decontamination", without_benchmarks),
    ("secret_scans", without_secrets),
    ("sentencepiece", tokenized),
]

# a trained model's decisions have no SQL counterpart
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table of documents: (doc_id, n_tokens, ids, decoded_sha256) of the documents that stay."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
