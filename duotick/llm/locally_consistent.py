"""Document fingerprints by locally consistent parsing.

Level 0 is the sequence of code points.  A level's symbols are cut into phrases where deterministic coin tossing says so: each symbol is
labelled by the lowest bit in which it differs from its left neighbour, and again, until labels are few; a local maximum of the labels begins a
phrase, and a run of equal symbols is a phrase of its own.  A phrase is named by a hash of its symbols, and the names are
the symbols of the next level.  Whether a cut is made depends on a few neighbours only, so equal substrings get equal
phrases inside, wherever they stand.

Levels follow until a text is one phrase, whose name stands for the whole text; each level has at most two thirds of the symbols of the one below or so.

The fingerprint is a bottom-k sketch: the least ``k`` hashes of the names of all levels from ``SKETCH_FROM`` on.
Two sketches estimate the share of names that the texts have in common.

All documents of a batch are parsed together, as one array with marks where each begins; no step looks across a mark.

Defined results.  Null or empty text: an empty fingerprint, alike (1.0) to an empty one and to no other (0.0).  Equal texts have
equal fingerprints.  Empty table: no rows.  Repeated rows: a row each, ordered by ``doc_id``, then text.  Null ``doc_id``: first in
order.  A single document is its own next.  Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from . import common

#: The lowest level whose names are sketched; every text has it.  A phrase of level 2 has about ten characters, of level 3 about thirty.
SKETCH_FROM = 2
SKETCH_SIZE = 64

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def _toss(label: np.ndarray, first: np.ndarray) -> np.ndarray:
    """2 * (lowest bit that differs from the left neighbour) + that bit; the first symbol of a text has a fixed neighbour."""
    left = np.empty_like(label)
    left[1:] = label[:-1]
    left[first] = ~label[first]
    differ = label ^ left
    low = differ & (~differ + label.dtype.type(1))
    place = np.bitwise_count(low - label.dtype.type(1)).astype(np.uint8)
    bit = (label & low) != 0
    return 2 * place + bit


def phrase_starts(symbols: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Marks the symbols that begin a phrase; ``first`` holds the place where each text begins."""
    n = len(symbols)
    begin = np.zeros(n, dtype=bool)
    begin[first] = True
    same = np.zeros(n + 1, dtype=bool)  # equal to the left neighbour of the same text
    same[1:n] = symbols[1:] == symbols[:-1]
    same[first] = False
    # runs of three or more are phrases: they begin where the run does, and what follows begins anew
    in_run = same[:n] | same[1:]
    long_run = np.zeros(n, dtype=bool)
    triple = np.flatnonzero(same[1:n] & same[2 : n + 1]) + 1
    if len(triple):
        run_id = np.cumsum(~same[:n])
        long_run = np.isin(run_id, np.unique(run_id[triple])) & in_run
        begin |= long_run & ~same[:n]
        after = np.flatnonzero(long_run[:-1] & ~long_run[1:]) + 1
        begin[after] = True
    # labels; inside short runs equal neighbours get the label of bit 63, so a tie is broken by place alone
    label = _toss(symbols, first)
    label = _toss(label, first)
    label = _toss(label, first)
    left = np.empty(n, dtype=np.int16)
    left[1:] = label[:-1]
    left[first] = -1
    right = np.empty(n, dtype=np.int16)
    right[:-1] = label[1:]
    right[first[1:] - 1] = -1
    right[-1] = -1
    peak = (label > left) & (label >= right) & ~long_run
    # no phrase of one symbol beside a forced cut
    forced = begin.copy()
    last = np.append(first[1:] - 1, n - 1)
    peak[1:] &= ~forced[:-1]
    peak[:-1] &= ~(forced[1:] & ~long_run[1:])
    peak[last] = False
    return begin | peak


def next_level(symbols: np.ndarray, first: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    """Names of the phrases, and where each text begins among them."""
    begin = phrase_starts(symbols, first)
    at = np.flatnonzero(begin)
    place = np.arange(len(symbols), dtype=np.uint64) - np.repeat(at, np.diff(np.append(at, len(symbols)))).astype(np.uint64)
    names = _mix(np.add.reduceat(_mix(symbols + (place << np.uint64(1) | np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)), at) + np.uint64(level))
    return names, np.searchsorted(at, first)


def sketches(texts: list[str], sketch_from: int = SKETCH_FROM, size: int = SKETCH_SIZE) -> list[np.ndarray]:
    """The least ``size`` distinct 32-bit hashes of the phrase names of each text, ascending."""
    out: list[np.ndarray] = [np.zeros(0, dtype=np.uint32)] * len(texts)
    full = [i for i, t in enumerate(texts) if t]
    if not full:
        return out
    lengths = np.array([len(texts[i]) for i in full])
    first = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    symbols = _mix(np.frombuffer("".join(texts[i] for i in full).encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64))
    rows, found, open_, level = [], [], np.arange(len(full)), 0
    while len(open_):
        level += 1
        symbols, first = next_level(symbols, first, level)
        lengths = np.diff(np.append(first, len(symbols)))
        if level < sketch_from:
            continue
        rows.append(np.repeat(open_, lengths))
        found.append((symbols >> np.uint64(32)).astype(np.uint32))
        # texts that are one phrase are done
        more = lengths > 1
        symbols, open_, lengths = symbols[np.repeat(more, lengths)], open_[more], lengths[more]
        first = np.cumsum(lengths) - lengths
    row, name = np.concatenate(rows), np.concatenate(found)
    both = np.sort(row.astype(np.uint64) << np.uint64(32) | name)  # by text, then by hash
    both = both[np.concatenate([[True], both[1:] != both[:-1]])]
    ends = np.searchsorted(both, np.arange(len(full) + 1, dtype=np.uint64) << np.uint64(32))
    for k, i in enumerate(full):
        out[i] = both[ends[k] : min(ends[k + 1], ends[k] + size)].astype(np.uint32)
    return out


def likeness(a: np.ndarray, b: np.ndarray, size: int = SKETCH_SIZE) -> float:
    """The share of names in common, 2 J / (1 + J) for the Jaccard estimate J of two bottom-k sketches."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    union = np.union1d(a, b)[:size]
    both = int((np.isin(union, a, assume_unique=True) & np.isin(union, b, assume_unique=True)).sum())
    return 2 * both / (len(union) + both)


def as_text(sketch: np.ndarray) -> str:
    return sketch.astype(">u4").tobytes().hex()


def edited(text: str, following: str) -> str:
    """The last quarter of the code points gives way to the first as many of the next document."""
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


# -- the operator -----------------------------------------------------------------------------------------------------------


def _rows_of(group: list[tuple[int | None, str]], closing: str) -> list[tuple]:
    """``group``: consecutive documents; ``closing``: the text that follows the last."""
    texts = [t for _, t in group] + [closing]
    changed = [edited(t, texts[i + 1]) for i, t in enumerate(texts[:-1])]
    prints = sketches(texts)
    edits = sketches(changed)
    out = []
    for i, (doc_id, text) in enumerate(group):
        same = hashlib.sha256(changed[i].encode("utf-8", "surrogatepass")).hexdigest()
        out.append((doc_id, len(text), same, as_text(prints[i]), as_text(edits[i]), likeness(prints[i], edits[i]), likeness(prints[i], prints[i + 1])))
    return out


SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_ARROW = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), *((c, pa.string()) for c in ("edited_sha256", "fingerprint", "edited_fingerprint")), ("near_edited", pa.float64()), ("near_next", pa.float64())])

#: Characters that are parsed together, unless one text has more.
BATCH_CHARS = 150_000


def _parse_ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come by range, in order; each range ends with a row that only closes it."""

    def rows() -> Iterator[tuple[bool, int | None, str]]:
        for batch in batches:
            for at, texts in common.text_pieces(batch):
                part = batch.slice(at, len(texts))
                yield from zip(common.column(part, "closes").to_pylist(), common.column(part, "doc_id").to_pylist(), texts, strict=True)

    group: list[tuple[int | None, str]] = []
    chars = 0
    for closes, doc_id, text in rows():
        if group and (closes or chars >= BATCH_CHARS):
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*_rows_of(group, text), strict=True), _ARROW, strict=True)], schema=_ARROW)
            group, chars = [], 0
        if not closes:
            group.append((doc_id, text))
            chars += len(text)


def _range_number(bounds: list[int]) -> Column:
    """How many of the ascending ``bounds`` are not above ``doc_id``, by binary search; 0 for null."""
    if not bounds:
        return F.lit(0)
    steps = [1 << k for k in reversed(range(len(bounds).bit_length()))]
    listed = F.array(*map(F.lit, bounds))
    reached = lambda n, s: (n + s <= len(bounds)) & (F.get(listed, n + s - 1) <= F.col("doc_id"))
    return F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), lambda n, s: F.when(reached(n, s), n + s).otherwise(n))


def fingerprints_with_edits(docs: DataFrame, ranges: int | None = None) -> DataFrame:
    """Every document's fingerprint and that of its edited text, with the likenesses.

    Documents are dealt by ranges of ``doc_id``, bounded by a quantile sketch over the ids alone; the first document of a range goes to the
    range before as well (that of the first to the last), where it closes the order.  So the texts move once.
    """
    spark = docs.sparkSession
    ranges = ranges or common.partitions_for(docs)
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    cuts = [i / ranges for i in range(1, ranges)]
    found = source.agg(F.percentile_approx("doc_id", cuts, min(100 * ranges, 100_000)).alias("q")).first()["q"] if cuts else []
    bounds = sorted(set(found or []))
    number = _range_number(bounds)
    # one row for each range at most: the id of its first document
    key = F.coalesce("doc_id", F.lit(-(1 << 63)))
    firsts = source.select(number.alias("range"), key.alias("low")).groupBy("range").agg(F.min("low").alias("low")).orderBy("range").collect()
    if not firsts:
        return spark.createDataFrame([], SCHEMA)
    opens = F.broadcast(spark.createDataFrame([(r["low"], firsts[i - 1]["range"]) for i, r in enumerate(firsts)], "low long, range int"))
    # the text that opens a range is the least among those that share the id
    closing = source.withColumn("low", key).join(opens, "low").groupBy("low", "range").agg(F.min("text").alias("text"))
    closing = closing.select("range", F.lit(True).alias("closes"), F.lit(None).cast("long").alias("doc_id"), "text")
    body = source.select(number.alias("range"), F.lit(False).alias("closes"), "doc_id", "text")
    common.prepare(spark)
    dealt = body.unionByName(closing).repartitionById(len(bounds) + 1, F.col("range"))
    return dealt.sortWithinPartitions("range", "closes", "doc_id", "text").drop("range").mapInArrow(_parse_ranges, SCHEMA)
