"""From raw documents to token ids: quality rules, near-dedup, decontamination, secret scan, encoding.

Every stage takes (spark, docs, sf_dir), works on all that the stage before kept and
returns a DataFrame that is written as Parquet and read again as the next one's docs.
All but the last return the columns of ``documents``:

- quality rules: documents that fail the base rules or the trained verdict go;
- near-dedup: one document of each class stays, that of the smallest id;
- decontamination: documents that hold a benchmark item go;
- secret scan: spans of the text that are secrets become a placeholder, every document stays;
- encoding: token ids, their number and digests of ids and decoded text.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tillscope.llm import bpe, decontaminate, minhash, quality_rules, secrets
from tillscope.session import scratch_path


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.keep_good(docs, _table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_leaks(docs, _table(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact_secrets(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    vocabulary = bpe.Vocabulary.read(public_tokenizers.path("word_bpe_49k.json"))
    return bpe.encode_with_digests(docs, vocabulary)


STAGES = [
    ("quality_rules", keep_quality),
    ("minhash_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("secret_scan", redact_secrets),
    ("bpe_encoding", encode),
]

# Trained verdicts, signatures and encodings are beyond SQL; the tests hold each stage against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder; each result is stored before the next stage reads it."""
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
