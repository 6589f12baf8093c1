"""Stages of the pipeline on small tables with planted rows, against plain Python."""

from __future__ import annotations

import re

import corpus_pipeline

from .test_line_templates import slow_drops, texts
from .test_shingle_jaccard import planted, slow_kept


def run(spark, stage, given):
    docs = spark.createDataFrame(list(given.items()), "doc_id long, text string")
    rows = dict(corpus_pipeline.STAGES)[stage](spark, docs, "").collect()
    got = {r["doc_id"]: r["text"] for r in rows}
    assert len(got) == len(rows)
    return got


def test_lines(spark):
    passage = " ".join(f"w{a}{b}" for a in "abcdefgh" for b in "abcdefgh")
    given = texts() | {50: f"one line of its own\n{passage}", 60: f"{passage}\nanother line of its own"}
    got = run(spark, "line_dedup", given)
    assert got == slow_drops(given, 2) and got[60] == "another line of its own"


def test_near_duplicates(spark):
    given = planted(9)
    assert run(spark, "simhash_near_dedup", given) == {i: given[i] for i in slow_kept(given)} != given


def test_personal_data(spark):
    found = re.compile(r"[\w.]+@[\w.]+\w|\b\d{1,3}(?:\.\d{1,3}){3}\b|\b\d{3}-\d{2}-\d{4}\b|(?<=token=)\w{12,}")
    given = {i: f"plain words {i} mary{i % 5}@mail{i % 3}.example.com from 10.1.2.{i % 7} ssn 123-45-{6000 + i % 4} token={'q7' * (20 + 100 * (i % 3))} end" for i in range(30)} | {99: "no entity at all"}
    got = run(spark, "pii", given)
    assert got[99] == given[99] and set(got) == set(given)
    old, new = ([e for i in sorted(given) for e in found.findall(d[i])] for d in (given, got))
    pairs = set(zip(old, new, strict=True))
    # one surrogate for an entity, one entity for a surrogate, none that is an entity; the rest of the text stays
    assert len(pairs) == len({a for a, _ in pairs}) == len({b for _, b in pairs}) and not set(old) & set(new)
    assert all(found.sub("#", got[i]) == found.sub("#", given[i]) for i in given)
