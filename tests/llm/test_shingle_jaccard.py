"""Near-duplicates at Jaccard 0.8 of five-word shingles, against all pairs."""

from __future__ import annotations

import random

import numpy as np
import pytest

import corpus_pipeline
from duotick.llm import shingle_jaccard


def shingles(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text).split()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def slow_kept(texts):
    """The least id of each component of similar texts."""
    sets, root = {i: shingles(t or "") for i, t in texts.items()}, {i: i for i in texts}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(texts)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if sets[a] == sets[b] or 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i for i in ids if find(i) == i}


def planted(seed=4):
    """Edited copies at Jaccard 0.7 to 0.99, chains of them, exact copies, short and empty texts."""
    rng = random.Random(seed)
    words = ["".join(rng.choices("abcdefgh", k=7)) for _ in range(3000)]
    texts = ["", None, " ", "two words", "Two  words", "two other words"]
    for n in (7, 12, 25, 60, 120, 300):
        for _ in range(6):
            text = rng.choices(words, k=n)
            texts.append(" ".join(text))
            for _ in range(6):
                text = list(text)
                for _ in range(rng.randint(0, 1 + n // 60)):
                    text[rng.randrange(n)] = rng.choice(words)
                texts.append(" ".join(text))
    rng.shuffle(texts)
    return dict(enumerate(texts))


def test_stage_keeps_one_of_each_component(spark):
    texts = planted()
    docs = spark.createDataFrame([(i, t, "kept") for i, t in texts.items()], "doc_id long, text string, lang string")
    out = corpus_pipeline.near_duplicates(spark, docs, "").collect()
    assert {r["doc_id"] for r in out} == slow_kept(texts) and len(out) == len({r["doc_id"] for r in out}) < len(texts)
    assert all((r["text"], r["lang"]) == (texts[r["doc_id"]], "kept") for r in out)


@pytest.mark.parametrize(("share", "block"), [(0.3, 3), (0.05, 2048), (1.0, 2048), (0.3, 2048)])
def test_components_do_not_depend_on_range_or_blocks(spark, share, block):
    texts = planted(5)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    rows = shingle_jaccard.near_duplicate_classes(docs, share=share, block=block).collect()
    least = {}
    for r in rows:
        least[r["component"]] = min(least.get(r["component"], 1 << 60), r["first"]["doc_id"])
    assert set(least.values()) == slow_kept(texts)


def test_a_passage_that_all_share_links_nobody(spark):
    """Every document has the passage as three quarters of its words: all share keys, no two are similar, and a chain of near copies is found."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choices("abcdefgh", k=7))
    passage = [word() for _ in range(150)]
    texts = {i: " ".join(passage + [word() for _ in range(50)]) for i in range(60)}
    texts |= {100 + i: texts[i].replace(passage[40], word()) for i in range(5)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    kept = {r["doc_id"] for r in shingle_jaccard.one_of_each_component(docs).collect()}
    assert kept == slow_kept(texts) == set(range(60))


def test_sketches_rule_out_no_similar_pair():
    rng = np.random.default_rng(3)
    for n in (1, 5, 30, 64, 65, 100, 700, 3000):
        base = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
        for _ in range(20):
            cut = int(rng.integers(0, max(1, n // 9) + 1))
            other = np.unique(np.concatenate([base[cut:], rng.integers(0, 1 << 63, int(rng.integers(0, max(1, n // 9) + 1)), dtype=np.uint64)]))
            shared = len(np.intersect1d(base, other))
            if 10 * shared >= 8 * (len(base) + len(other) - shared):
                found = list(shingle_jaccard.likely_pairs(np.array([len(base), len(other)]), np.array([1, 2]), [shingle_jaccard.parity(base), shingle_jaccard.parity(other)]))
                assert len(found) == 1


def test_rows_of_one_id(spark):
    """Unlike texts of one id are judged each by itself; repeated rows count once; rows without an id stay."""
    rows = [(1, "one two three four five six seven"), (1, "quite another text of seven words here"), (2, "One two three four five six seven"), (3, "same words all over again and again"), (3, "same words all over again and again"), (None, "no id"), (None, "no id"), (4, None), (5, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = sorted((str(r["doc_id"]), str(r["text"])) for r in shingle_jaccard.one_of_each_component(docs).collect())
    assert kept == sorted((str(a), str(b)) for a, b in [rows[0], rows[1], rows[3], rows[5], rows[6], rows[7]])
    assert shingle_jaccard.one_of_each_component(docs.where("false")).count() == 0
