"""Quality rules learned as a decision list.

Every whole text is reduced once to counts (``document_stats``).  A learner on the driver sees a bounded sample of
labelled counts and, by sequential covering, grows conjunctions of thresholds by FOIL gain, prunes them on rows it did
not grow on, and keeps those that are precise.  The list becomes one ordered Spark CASE expression.

Defined results.  Null text: no words, so the base rules reject it.  Empty table: no rows.  Repeated rows: a row each.
No labels, or labels of one class: the list is empty and only the base rules decide.  A ``doc_id`` labelled twice counts as
poor if any label says so.  Columns of the input other than ``doc_id`` and ``text`` are ignored, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass
from operator import and_
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from . import common

#: Labelled rows that the learner sees at most; those with the smallest hash of ``doc_id`` are taken.
SAMPLE_ROWS = 40_000

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_distinct_words", "n_upper", "n_lower", "n_digits", "n_pipes", "n_bangs", "n_stops")
STATS_SCHEMA = "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS)

_SPACE = b" \t\n\x0b\x0c\r"
_UPPER, _LOWER, _DIGIT = bytes(range(65, 91)), bytes(range(97, 123)), bytes(range(48, 58))


def repeated_words(words: list[bytes], width: int = 5) -> int:
    """Words that lie in a window of ``width`` words which the text has twice or more, first occurrences included."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    windows = list(zip(*(words[i:] for i in range(width)), strict=False))
    first: dict[tuple, int] = {}
    repeated = bytearray(n)
    if len(set(windows)) == n:
        return 0
    for i, w in enumerate(windows):
        j = first.setdefault(w, i)
        if j != i:
            repeated[i] = repeated[j] = 1
    covered = end = 0
    for i in np.flatnonzero(np.frombuffer(repeated, dtype=np.uint8)).tolist():
        covered += i + width - max(i, end)
        end = i + width
    return covered


def text_counts(text: str) -> tuple[int, ...]:
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    drop = lambda chars: len(raw) - len(raw.translate(None, chars))
    lines = [x for x in raw.split(b"\n") if x.strip(_SPACE)]
    return (
        len(words),
        len(text) - drop(_SPACE),
        drop(b"#*$%&|<>"),
        len(lines) - len(set(lines)),
        repeated_words(words),
        len(lines),
        len(set(words)),
        drop(_UPPER),
        drop(_LOWER),
        drop(_DIGIT),
        raw.count(b"|"),
        raw.count(b"!"),
        raw.count(b"."),
    )


def _stats_batch(batch: pa.RecordBatch) -> pa.RecordBatch:
    rows: list[tuple[int, ...]] = []
    for _, texts in common.text_pieces(batch):
        rows += map(text_counts, texts)
    table = np.array(rows, dtype=np.int64).reshape(len(rows), len(COUNTS))
    return pa.RecordBatch.from_arrays([common.column(batch, "doc_id"), *(pa.array(table[:, i]) for i in range(len(COUNTS)))], names=["doc_id", *COUNTS])


def document_stats(docs: DataFrame) -> DataFrame:
    return common.map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), _stats_batch, STATS_SCHEMA)


_COUNTED = "__duotick_counts"


def with_counts(docs: DataFrame) -> DataFrame:
    """All columns of ``docs`` and the counts as one struct column, whose name nothing else has."""

    def batch(b: pa.RecordBatch) -> pa.RecordBatch:
        counts = _stats_batch(b)
        return b.append_column(_COUNTED, pa.StructArray.from_arrays(counts.columns[1:], names=list(COUNTS)))

    counted = T.StructField(_COUNTED, T.StructType([T.StructField(c, T.LongType()) for c in COUNTS]))
    schema = T.StructType([*docs.schema.fields, counted])
    return common.map_batches(docs, batch, schema)


#: Features of a rule, as SQL over the counts.
FEATURES = {
    "n_words": "CAST(n_words AS DOUBLE)",
    "mean_word_chars": "word_chars / greatest(n_words, 1)",
    "symbols_per_word": "n_symbols / greatest(n_words, 1)",
    "pipes_per_word": "n_pipes / greatest(n_words, 1)",
    "bangs_per_word": "n_bangs / greatest(n_words, 1)",
    "dup_line_share": "n_dup_lines / greatest(n_lines, 1)",
    "repeat_word_share": "n_repeat_words / greatest(n_words, 1)",
    "distinct_word_share": "n_distinct_words / greatest(n_words, 1)",
    "upper_share": "n_upper / greatest(n_upper + n_lower, 1)",
    "digits_per_char": "n_digits / greatest(word_chars, 1)",
    "words_per_line": "n_words / greatest(n_lines, 1)",
    "stops_per_word": "n_stops / greatest(n_words, 1)",
}


@dataclass(frozen=True)
class Condition:
    feature: str
    op: str  # ">=" or "<"
    threshold: float

    def holds(self, x: dict[str, np.ndarray]) -> np.ndarray:
        return x[self.feature] >= self.threshold if self.op == ">=" else x[self.feature] < self.threshold

    def column(self) -> Column:
        value, bound = F.expr(FEATURES[self.feature]), F.lit(float(self.threshold))
        return value >= bound if self.op == ">=" else value < bound

    def __str__(self) -> str:
        return f"{self.feature} {self.op} {self.threshold:.6g}"


Rule = tuple[Condition, ...]


def _covers(rule: Rule, x: dict[str, np.ndarray], n: int) -> np.ndarray:
    return reduce(and_, (c.holds(x) for c in rule), np.ones(n, dtype=bool))


def _grow(x: dict[str, np.ndarray], poor: np.ndarray, max_conditions: int, cuts: int) -> Rule:
    """Add the threshold of the highest FOIL gain until the rule covers no good row or gains nothing."""
    rule: Rule = ()
    inside = np.ones(len(poor), dtype=bool)
    while len(rule) < max_conditions:
        p0, n0 = int(poor[inside].sum()), int((~poor[inside]).sum())
        if not p0 or not n0:
            break
        base, best = np.log2(p0 / (p0 + n0)), (1e-9, None)
        for name, values in x.items():
            v, y = values[inside], poor[inside]
            order = np.argsort(v, kind="stable")
            v, y = v[order], y[order]
            below = np.concatenate([[0], np.cumsum(y)])
            at = np.unique(np.searchsorted(v, np.unique(np.quantile(v, np.linspace(0, 1, cuts + 1)))))
            at = at[(at > 0) & (at < len(v))]
            for i in at.tolist():
                threshold = float((v[i - 1] + v[i]) / 2)
                for op, p, total in (("<", below[i], i), (">=", p0 - below[i], len(v) - i)):
                    if p and (gain := p * (np.log2(p / total) - base)) > best[0]:
                        best = (gain, Condition(name, op, threshold))
        if best[1] is None:
            break
        rule += (best[1],)
        inside &= best[1].holds(x)
    return rule


def _prune(rule: Rule, x: dict[str, np.ndarray], poor: np.ndarray) -> Rule:
    """The shortest prefix with the best (poor - good) / (poor + good) on the rows held back."""

    def worth(r: Rule) -> float:
        inside = _covers(r, x, len(poor))
        total = int(inside.sum())
        return (2 * int(poor[inside].sum()) - total) / total if total else -1.0

    return max((rule[:i] for i in range(1, len(rule) + 1)), key=lambda r: (worth(r), -len(r)), default=())


def learn_decision_list(x: dict[str, np.ndarray], poor: np.ndarray, max_rules: int = 12, max_conditions: int = 4, cuts: int = 48, min_precision: float = 0.9, min_cover: int = 5) -> list[Rule]:
    """Sequential covering of the poor rows.  Every third row prunes; a rule must be precise on the rows held back and on all."""
    rules: list[Rule] = []
    left = np.ones(len(poor), dtype=bool)
    held = np.arange(len(poor)) % 3 == 2
    while len(rules) < max_rules:
        g, h = left & ~held, left & held
        if poor[g].sum() < min_cover or not poor[h].any():
            break
        rule = _prune(_grow({k: v[g] for k, v in x.items()}, poor[g], max_conditions, cuts), {k: v[h] for k, v in x.items()}, poor[h])
        if not rule:
            break
        inside = _covers(rule, x, len(poor)) & left
        precise = lambda rows: rows.any() and poor[rows].mean() >= min_precision
        if poor[inside].sum() < min_cover or not precise(inside) or not precise(inside & held):
            break
        rules.append(rule)
        left &= ~inside
    return rules


def rule_number(rules: list[Rule]) -> Column:
    """1 for rows of the first rule, 2 for those of the second that the first doesn't cover, ...; 0 for the rest."""
    out = None
    for i, rule in enumerate(rules, 1):
        test = reduce(and_, (c.column() for c in rule))
        out = F.when(test, F.lit(i)) if out is None else out.when(test, F.lit(i))
    return F.lit(0) if out is None else out.otherwise(F.lit(0))


def labelled_sample(stats: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """Features and poor flags of at most ``sample_rows`` labelled rows, collected in order of a hash of the id."""
    chosen = (
        labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("quality"))
        .withColumn("h", F.xxhash64("doc_id")).orderBy("h", "doc_id").limit(sample_rows)
    )
    # bounded by ``sample_rows``: three numbers for each
    rows = stats.join(F.broadcast(chosen), "doc_id").dropDuplicates(["doc_id"]).select("h", "doc_id", "quality", *(F.expr(e).alias(f"f_{k}") for k, e in FEATURES.items())).orderBy("h", "doc_id").limit(sample_rows).toPandas()
    return {k: rows[f"f_{k}"].to_numpy(dtype=np.float64) for k in FEATURES}, rows["quality"].to_numpy() == 0


def apply_rules(stats: DataFrame, rules: list[Rule]) -> DataFrame:
    """Counts with ``base_failed``, ``rule`` (0: none) and ``kept``."""
    base = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return stats.select("*", base.alias("base_failed"), rule_number(rules).alias("rule")).withColumn("kept", ~F.col("base_failed") & (F.col("rule") == 0))


def quality_verdicts(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """One row for each document: its counts, ``base_failed``, the ``rule`` that rejects it and ``kept``."""
    stats = common.materialize(document_stats(docs), "quality")
    return apply_rules(stats, learn_decision_list(*labelled_sample(stats, labels, sample_rows)))


def reject_poor(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The documents that are kept, with all their columns; each row is judged by its own text, so ids may be null or repeat.

    The texts are written once with their counts, since the rules need the counts of labelled rows first; no join moves a text.
    """
    counted = common.materialize(with_counts(docs), "counted")
    rules = learn_decision_list(*labelled_sample(counted.select("doc_id", f"{_COUNTED}.*"), labels, sample_rows))
    judged = apply_rules(counted.select(F.struct(*docs.columns).alias("row"), f"{_COUNTED}.*"), rules)
    return judged.where("kept").select("row.*")
