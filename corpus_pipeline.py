"""Documents to packed sequences, in stages that are each written and read again."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from duotick.llm import common, line_templates, packing, pii, quality_rules, shingle_jaccard
from duotick.llm.queries import PII_KEY


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the learned list reject go."""
    return quality_rules.reject_poor(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of recurring templates go from all documents but the first that has them."""
    return line_templates.drop_recurring_lines(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents whose five-word shingles have a Jaccard similarity of 0.8 or more, and of chains of such, the one with the least id stays.

    Candidates are what the SimHash operator links by its Golay keys, and what the sets' rarest shingles add to that.
    """
    return shingle_jaccard.one_of_each_component(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Entities give way to surrogates."""
    return pii.replace_entities(docs, PII_KEY)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The places of all documents' pieces in sequences of 1,024 ids."""
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=0)


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality),
    ("line_dedup", lines),
    ("simhash_near_dedup", near_duplicates),
    ("pii", personal_data),
    ("packing", pack),
]

#: Learned rules, fingerprints and token ids have no SQL form; tests hold the line, near-copy and personal-data stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents; each result is written, then the tables that it was computed from are removed."""
    docs, read = common.documents(spark, sf_dir), []
    for name, stage in STAGES:
        with common.scratch_scope() as paths:
            docs = common.materialize(stage(spark, docs, sf_dir), name)
        common.remove(spark, read + paths[:-1])
        read = paths[-1:]
    return docs
