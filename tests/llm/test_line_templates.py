"""Line dedup against plain Python, with variables in every place."""

from __future__ import annotations

import random
import re

import pytest

from duotick.llm import line_templates


def tokens_of(line):
    words = line.split()
    tokens = ["<*>" if re.search("[0-9]", w) else w for w in words]
    return words if len(words) < 3 and set(tokens) == {"<*>"} else tokens


def slow_drops(texts, min_docs):
    """The lines that stay, by document: every pair of lines of a length and a first token is compared."""
    order = {tuple(tokens_of(x)): line_templates._hash(" ".join(tokens_of(x)).encode()) for t in texts.values() for x in t.split("\n") if x.split()}
    founders, template = [], {}
    for t in sorted(order, key=order.get):
        near = [f for f in founders if len(f) == len(t) and f[0] == t[0] and 10 * sum(a == b for a, b in zip(f, t)) >= 8 * len(t)]
        template[t] = near[0] if near else t
        founders += [] if near else [t]
    docs = {}
    for i, text in texts.items():
        for x in text.split("\n"):
            if x.split():
                docs.setdefault(template[tuple(tokens_of(x))], set()).add(i)
    goes = lambda i, x: bool(x.split()) and len(d := docs[template[tuple(tokens_of(x))]]) >= min_docs and min(d) != i
    return {i: "\n".join(x for x in text.split("\n") if not goes(i, x)) for i, text in texts.items()}


def texts():
    rng = random.Random(11)
    words = ["".join(rng.choices("abcdefgh", k=6)) for _ in range(400)]
    out = {}
    stems = [rng.choices(words, k=n) for n in (5, 6, 9, 10, 14, 23, 60, 100) for _ in range(3)]
    for i in range(40):
        lines = [" ".join(rng.choices(words, k=rng.randint(3, 30))) for _ in range(3)] + [""]
        for _ in range(3):
            line = list(rng.choice(stems))
            for k in rng.sample(range(1, len(line)), rng.randint(0, len(line) // 5 + 1)):
                line[k] = rng.choice(words)
            lines.append(" ".join(line))
        rng.shuffle(lines)
        out[i] = "\n".join(lines)
    return out


@pytest.mark.parametrize("part", [2000, 4])
def test_variables_in_early_places(spark, monkeypatch, part):
    monkeypatch.setattr(line_templates.line_templates, "__defaults__", (line_templates.SIMILARITY, part))
    given = texts()
    given |= {100 + k: f"The {c} fox runs over" for k, c in enumerate(("red", "green", "blue"))}
    got = {r["doc_id"]: r["text"] for r in line_templates.drop_recurring_lines(spark.createDataFrame(list(given.items()), "doc_id long, text string"), min_docs=3).collect()}
    assert got == slow_drops(given, 3) and got != given
    assert [got[100 + k] for k in range(3)] == ["The red fox runs over", "", ""]


def test_edit_early_in_a_long_line(spark):
    line = [f"w{c}" for c in "abcdefghijklmnopqrst"] * 5
    given = {k: " ".join([*line[:9], c, *line[10:]]) for k, c in enumerate(("red", "green", "blue"))}
    got = {r["doc_id"]: r["text"] for r in line_templates.drop_recurring_lines(spark.createDataFrame(list(given.items()), "doc_id long, text string")).collect()}
    assert got == {0: given[0], 1: "", 2: ""}


def test_two_documents_and_short_lines(spark):
    passage = " ".join(f"w{a}{b}" for a in "abcdefgh" for b in "abcdefgh")
    given = {0: f"{passage}\nRead more\n12\nPage 3", 1: f"own line here\n{passage}\nMenu", 2: "Read more\nMenu\n13\nPage 4", 3: "12\n\nRead less\nMenu"}
    got = {r["doc_id"]: r["text"] for r in line_templates.drop_recurring_lines(spark.createDataFrame(list(given.items()), "doc_id long, text string")).collect()}
    assert got == {0: given[0], 1: "own line here\nMenu", 2: "13", 3: "\nRead less"} == slow_drops(given, 2)


def test_whole_documents_from_two_on(spark):
    given = texts()
    got = {r["doc_id"]: r["text"] for r in line_templates.drop_recurring_lines(spark.createDataFrame(list(given.items()), "doc_id long, text string")).collect()}
    assert got == slow_drops(given, 2) != slow_drops(given, 3)
