"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns, for every operator."""

from __future__ import annotations

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from duotick.llm import bpe_segment_tree, line_templates, locally_consistent, packing, pii, quality_rules, separator_scan, shingle_jaccard, simhash_golay, sstable, toxicity

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
LONG = "wort und mehr " * 20_000
ROWS = [
    (1, "Some plain text, about ten words long, or a few more than that."), (2, None), (3, ""), (4, LONG), (5, "x" * 60_000), (6, "same text"), (6, "same text"),
    (7, "same text"), (None, "no id here"), (8, " \n\t\n "), (9, "é́ ü \U0001f600 \x00 <|endoftext|>"), (10, "a@b.example.com " * 3),
]


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string")
    # columns that operators use as names of their own
    extra = ["fp", "rep", "key", "kept", "length", "start", "ids", "shard", "n", "leaf", "line", "score", "kind", "row", "n_words", "closes", "h"]
    return df.select("*", *(F.lit("clash").alias(c) for c in extra))


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (1, 0, None), (3, None, 1), (None, 0, 1)], "doc_id long, quality int, toxic int")


OPERATORS = {
    "pii": lambda d, lab: pii.replace_entities(d, "key"),
    "quality": lambda d, lab: quality_rules.quality_verdicts(d, lab),
    "simhash": lambda d, lab: simhash_golay.near_duplicate_components(d),
    "toxicity": lambda d, lab: toxicity.toxicity(d, lab),
    "lines": lambda d, lab: line_templates.drop_recurring_lines(d),
    "sstable": lambda d, lab: sstable.token_shards(d, BYTE),
    "fingerprints": lambda d, lab: locally_consistent.fingerprints_with_edits(d),
    "bpe": lambda d, lab: bpe_segment_tree.encode_decode(d, WORD),
    "counts": lambda d, lab: separator_scan.document_token_counts(d, BYTE, 50256),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_a_row_for_each_row(docs, labels, name):
    got = sorted((r["doc_id"] or -1) for r in OPERATORS[name](docs, labels).collect())
    assert got == sorted((i or -1) for i, _ in ROWS)


@pytest.mark.parametrize("name", [*OPERATORS, "packing"])
def test_empty_table(docs, labels, name):
    operator = OPERATORS.get(name, lambda d, lab: packing.pack_documents(d, BYTE))
    assert operator(docs.where("false"), labels).count() == 0
    if name in ("quality", "toxicity"):
        assert operator(docs, labels.where("false")).count() == len(ROWS)


def test_rewriting_operators_keep_all_columns(docs, labels):
    for name in ("pii", "lines"):
        assert OPERATORS[name](docs, labels).columns == docs.columns
    assert quality_rules.reject_poor(docs, labels).columns == docs.columns
    assert simhash_golay.one_of_each_component(docs).columns == docs.columns


def test_null_stays_null_and_empty_empty(docs, labels):
    for name in ("pii", "lines"):
        got = {r["doc_id"]: r["text"] for r in OPERATORS[name](docs, labels).collect()}
        assert got[2] is None and got[3] == "" and got[4] == LONG and got[5] == "x" * 60_000


def test_equal_texts_share_a_component(docs):
    got = {r["doc_id"]: r["component_id"] for r in simhash_golay.near_duplicate_components(docs).collect()}
    assert got[6] == got[7] == 6 and got[2] == got[3] == got[8] == 2
    kept = [r["doc_id"] for r in simhash_golay.one_of_each_component(docs).collect()]
    assert kept.count(6) == 1 and 7 not in kept and 3 not in kept


def test_all_labels_of_one_kind(docs, spark):
    good = spark.createDataFrame([(1, 1, 0), (6, 1, 0)], "doc_id long, quality int, toxic int")
    assert {r["rule"] for r in quality_rules.quality_verdicts(docs, good).collect()} == {0}
    assert {r["score"] for r in toxicity.toxicity(docs, good).collect()} == {0.0}


def test_packing_of_all_rows(docs):
    """Nulls, empty and very long texts, repeated rows: each row's pieces lie gapless in their sequences."""
    rows = packing.pack_documents(docs, BYTE).collect()
    one = [r for r in rows if r["start"] == 0]
    assert sorted((r["doc_id"] or -1) for r in one) == sorted((i or -1) for i, _ in ROWS)
    assert {r["doc_id"]: r["doc_tokens"] for r in one}[2] == {r["doc_id"]: r["doc_tokens"] for r in one}[3] == 1
    places = {}
    for r in rows:
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in places.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
    assert sum(r["length"] for r in rows) == sum(r["doc_tokens"] for r in one)


def test_stages_judge_every_row_by_its_own_text(spark, labels):
    """Null ids, repeated rows, rows of one id and unlike texts, ties, and columns with names of their own."""
    good = "Plain words that nobody has any reason to reject, twelve of them at least here."
    rows = [(1, good), (1, "bad"), (None, good), (None, "bad"), (2, None), (3, ""), (4, good), (4, good)]
    given = spark.createDataFrame(rows, "doc_id long, text string").withColumn("rule", F.lit("clash")).withColumn("first", F.lit("clash")).withColumn("version", F.lit("clash"))
    kept = quality_rules.reject_poor(given, labels.where("false"))
    assert sorted(map(str, kept.collect())) == sorted(str(r) for r in given.collect() if r["text"] == good)
    alone = shingle_jaccard.one_of_each_component(given)
    assert alone.columns == given.columns
    assert sorted((str(r["doc_id"]), str(r["text"])) for r in alone.collect()) == sorted((str(a), str(b)) for a, b in [(1, good), (1, "bad"), (None, good), (None, "bad"), (2, None)])
    lines = line_templates.drop_recurring_lines(given)
    got = sorted((str(r["doc_id"]), str(r["text"])) for r in lines.collect())
    # rows of one id are one document, so its lines stay in all of them; of others they go
    assert got == sorted((str(a), str(b)) for a, b in [(1, good), (1, "bad"), (None, ""), (None, ""), (2, None), (3, ""), (4, ""), (4, "")])
