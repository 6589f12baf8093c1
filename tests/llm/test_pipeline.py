"""The stages one by one, each against what it reads."""

from __future__ import annotations

from collections import Counter

import corpus_pipeline
from duotick.llm import common

from ..conftest import SF


def test_stages(spark):
    docs = common.documents(spark, SF)
    columns = docs.columns
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        out = common.materialize(stage(spark, docs, SF), name)
        if name == "packing":
            assert {r["doc_id"] for r in out.collect()} == {r["doc_id"] for r in docs.collect()}
            assert "sequence_id" in out.columns
            break
        assert out.columns == columns
        before, after = ({r["doc_id"]: r["text"] for r in d.collect()} for d in (docs, out))
        assert set(after) <= set(before) and out.count() == len(after)
        kept[name] = len(after)
        if name in ("line_dedup", "pii"):
            assert set(after) == set(before)
        else:
            assert all(after[i] == before[i] for i in after)
        if name == "line_dedup":
            assert all(not Counter(x for x in after[i].split("\n") if x) - Counter(before[i].split("\n")) for i in after)
        docs = out
    assert kept["quality_rules"] > kept["simhash_near_dedup"] > 0


def test_run(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0
