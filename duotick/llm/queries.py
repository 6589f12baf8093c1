"""The queries of this folder, each over whole tables: ``(spark, sf_dir)`` to a DataFrame."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import bpe_segment_tree, common, line_templates, locally_consistent, packing, pii, quality_rules, separator_scan, simhash_golay, sstable, toxicity

#: A key for the test tables; a real one is a secret.
PII_KEY = "duotick test key"

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rewritten = pii.replace_entities(common.documents(spark, sf_dir).select("doc_id", "text"), key=PII_KEY, count_as="n_entities")
    return rewritten.select("doc_id", "n_entities", "text")


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    verdicts = quality_rules.quality_verdicts(common.documents(spark, sf_dir), _table(spark, sf_dir, "labels"))
    return verdicts.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")


def op3_simhash_golay(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_golay.near_duplicate_components(common.documents(spark, sf_dir))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op4_compression_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(common.documents(spark, sf_dir), _table(spark, sf_dir, "labels"))


def op5_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rewritten = line_templates.drop_recurring_lines(common.documents(spark, sf_dir).select("doc_id", "text"), count_as="n_dropped")
    return rewritten.select("doc_id", "text", "n_dropped")


def op6_sorted_string_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sstable.token_shards(common.documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), end_id=2)


def op7_nnls_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(common.documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), end_id=0)


def op8_locally_consistent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return locally_consistent.fingerprints_with_edits(common.documents(spark, sf_dir))


def op9_segment_tree_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_segment_tree.encode_decode(common.documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


def op10_separator_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return separator_scan.document_token_counts(common.documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), end_id=50256)


QUERIES: dict[str, Query] = {
    "op1_pii_surrogates": op1_pii_surrogates,
    "op2_quality_rules": op2_quality_rules,
    "op3_simhash_golay": op3_simhash_golay,
    "op4_compression_toxicity": op4_compression_toxicity,
    "op5_line_templates": op5_line_templates,
    "op6_sorted_string_table": op6_sorted_string_table,
    "op7_nnls_packing": op7_nnls_packing,
    "op8_locally_consistent": op8_locally_consistent,
    "op9_segment_tree_bpe": op9_segment_tree_bpe,
    "op10_separator_scan": op10_separator_scan,
}

#: Where SQL can express the whole operator.
ORACLE_SQL: dict[str, str] = {}
