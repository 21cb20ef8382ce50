"""Registered queries: each operator over its whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillscope.llm import (
    bpe,
    chat_format,
    decontaminate,
    fill_middle,
    language_id,
    licenses,
    merkle,
    minhash,
    passage_quality,
    quality_rules,
    secrets,
    token_counts,
    toxicity,
)
from tillscope.llm.labelled import small
from tillscope.llm.oracle import CHAT_SQL, FILL_MIDDLE_SQL, LICENSES_SQL, TOKEN_COUNTS_SQL
from tillscope.session import scratch_path


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Load all documents, withdraw those of low quality, recount toxic ones without digits, repeat a batch."""
    documents, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    rollup = token_counts.TokenRollup(spark, scratch_path(spark, "token-counts"))
    load = token_counts.count_tokens(documents, "insert")
    rollup.commit("load", load)
    rollup.commit("withdraw", token_counts.withdraw(labels.where("quality = 0 AND doc_id IS NOT NULL")))
    toxic = small(labels.where("toxic = 1").select("doc_id").distinct())
    revised = documents.join(toxic, "doc_id", "left_semi")
    masked = F.regexp_replace("text", "[0-9]+", "")
    rollup.commit("mask", token_counts.count_tokens(revised, "revise", masked))
    rollup.commit("load", load)
    return rollup.totals()


def op2_minhash(spark: SparkSession, folder: str) -> DataFrame:
    return minhash.duplicate_classes(table(spark, folder, "documents"))


def op3_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.toxicity(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op4_licenses(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.scan_licenses(licenses.files_of(table(spark, folder, "documents")))


def op5_secrets(spark: SparkSession, folder: str) -> DataFrame:
    return secrets.find_secrets(table(spark, folder, "documents"))


def op6_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return quality_rules.quality_rules(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op7_language_id(spark: SparkSession, folder: str) -> DataFrame:
    return language_id.identify_language(table(spark, folder, "documents"))


def op8_bpe(spark: SparkSession, folder: str) -> DataFrame:
    vocabulary = bpe.Vocabulary.read(public_tokenizers.path("word_bpe_49k.json"))
    return bpe.encoding_digests(table(spark, folder, "documents"), vocabulary)


def op9_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.leaked_items(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op10_passage_quality(spark: SparkSession, folder: str) -> DataFrame:
    return passage_quality.passage_quality(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op11_merkle(spark: SparkSession, folder: str) -> DataFrame:
    return merkle.merkle_manifest(table(spark, folder, "documents"))


def op12_chat_format(spark: SparkSession, folder: str) -> DataFrame:
    return chat_format.chat_digests(table(spark, folder, "conversations"))


def op13_fill_middle(spark: SparkSession, folder: str) -> DataFrame:
    return fill_middle.fill_in_middle(table(spark, folder, "documents"))


QUERIES = {
    "op1_token_counts": op1_token_counts,
    "op2_minhash": op2_minhash,
    "op3_toxicity": op3_toxicity,
    "op4_licenses": op4_licenses,
    "op5_secrets": op5_secrets,
    "op6_quality_rules": op6_quality_rules,
    "op7_language_id": op7_language_id,
    "op8_bpe": op8_bpe,
    "op9_decontaminate": op9_decontaminate,
    "op10_passage_quality": op10_passage_quality,
    "op11_merkle": op11_merkle,
    "op12_chat_format": op12_chat_format,
    "op13_fill_middle": op13_fill_middle,
}

ORACLE = {
    "op1_token_counts": TOKEN_COUNTS_SQL,
    "op4_licenses": LICENSES_SQL,
    "op12_chat_format": CHAT_SQL,
    "op13_fill_middle": FILL_MIDDLE_SQL,
}
